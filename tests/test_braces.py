"""Source code with braces: own examples for each kind of declaration."""

import pytest

from tablewell.operators import chunk
from tablewell.sources import documents
from tablewell.sources.braces import blanked, brace_code


def paths(text, language="script"):
    return [" ".join(b.headings) for b in brace_code(text, language)]


def test_script_functions_values_and_classes():
    text = """import { open } from 'fs';

export async function* rows(path) { yield `${path ? `{${path}` : '}'}`; }
export default function () { return /[}/]}/.test("}"); }
const half = (n: number): number => n / 2;
let late = async name => {
  return name;
};
@sealed
export class Ship<T> extends Hull {
  name = 'x';
  constructor(private crew: T[]) { super(); }
  get size(): number { return this.crew.length; }
  static async load<U>(at: string): Promise<U> { if (at) { for (;;) {} } }
  close = () => { this.name = ''; };
  #hidden() {}
}
module.exports = { Ship };
"""
    got = brace_code(text, "script")
    assert [" ".join(b.headings) for b in got] == [
        "preamble", "rows", "default", "half", "late", "Ship constructor", "Ship size", "Ship load", "Ship close", "Ship #hidden", "epilogue",
    ]
    assert got[0].text == "import { open } from 'fs';\n"[:-1] and "class Ship<T>" in got[5].text and all(b.kind == "code" for b in got)
    assert got[-1].text.endswith("module.exports = { Ship };")
    assert "".join("".join(b.text.split()) for b in got) == "".join(text.split())


def test_script_odd_files():
    assert paths("") == [] and paths("// only { a comment\n") == ["preamble"]
    assert paths("const one = () => 1, two = () => 2;") == ["one"]
    assert paths("class A {\n  f() {}\n}\nclass B {\n  g() {}\n}\n") == ["preamble", "A f", "B g"]
    assert paths("function f() {}\n\n}") == ["f"]
    assert paths("function f() { '\n}\n`never closed") == ["f", "epilogue"]
    assert paths("const sum = a\n  / b / c;\nfunction g() { return a / b } // }") == ["preamble", "g"]
    assert paths("namespace N {\n export class C {\n  m() {}\n }\n}") == ["preamble", "N.C m"]
    assert paths("if (x) { y() }\nwhile (z) { w() }") == ["preamble"]


def test_kotlin():
    text = '''package sea

@Serializable
fun <T> List<T>.second(): T = this[1]
val plus = { a: Int, b: Int -> a + b }
val less = fun(a: Int): Int = a - 1
const val LIMIT = 10
/* outer /* inner { */ still { */
suspend fun text(n: Int) = """{ ${if (n > 0) "}" else '{'} """
class Port(val name: String) : Place(name),
    Named {
    constructor() : this("none") { println("}") }
    inner class Berth { fun free() = true }
    companion object { fun make() = Port() }
    override fun toString(): String {
        return name
    }
}
interface Named { fun label(): String }
enum class Flag { RED, BLUE;
    fun low() = name.lowercase()
}
val count = 3
'''
    assert paths(text, "kotlin") == [
        "preamble", "second", "plus", "less", "text", "Port constructor", "Port.Berth free", "Port.Companion make", "Port toString", "Named label", "Flag low", "epilogue",
    ]
    got = brace_code(text, "kotlin")
    assert got[1].text.startswith("@Serializable") and "LIMIT" in got[4].text


def test_csharp():
    text = """using System;
namespace Sea.Ports
{
    public class Port<T> : Place where T : class
    {
        public int Depth { get; set; }
        [Obsolete("{")]
        public Port(string name) : base(name) { Name = name; }
        ~Port() { }
        public static Port<T> operator +(Port<T> a, Port<T> b) => a;
        public static implicit operator int(Port<T> p) => 1;
        public T this[int at] => crew[at];
        public string Label => $"{{{Name switch { "}" => "{", _ => @"a""}" }}}";
        public int Free { get { return 1; } }
        public event EventHandler Changed { add { } remove { } }
        public async Task<List<T>> Load(string at) { if (at == null) { return new List<T>(); } throw new Exception("x"); }
        string Named.Tag() => "t";
        record struct Berth(int At) { public int Next() => At + 1; }
        public int Last;
    }
}
"""
    assert paths(text, "csharp") == [
        "preamble", "Port constructor", "Port destructor", "Port operator", "Port operator", "Port this", "Port Label", "Port Free", "Port Changed",
        "Port Load", "Port Tag", "Port.Berth Next", "epilogue",
    ]
    assert paths("Console.Write(Twice(2));\n\nint Twice(int x) => x * 2;\n", "csharp") == ["preamble", "Twice"]
    assert paths("namespace A.B;\nclass C\n{\n  void M()\n  {\n  }\n}\n", "csharp") == ["preamble", "C M"]


@pytest.mark.parametrize("language", ["script", "kotlin", "csharp"])
def test_blanked_texts_keep_their_length_and_lines(language):
    for text in ["a \"b{\" 'c' /* d\n */ // e\n`f${g}`", '"""x', "$\"{a", "/*", "}}}{{{", "'", "\\", "", "${", '@"a""b" + "c"']:
        got = blanked(text, language)
        assert len(got) == len(text) and [k for k, c in enumerate(got) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]


def test_long_and_deep_code_takes_linear_time():
    deep = "class A {\n" * 3000 + "f() {}\n" + "}\n" * 3000
    assert paths(deep) == ["preamble"]
    many = "".join(f"class C{k} {{\n  run() {{ return `{{${{{k}}}`; }}\n}}\n" for k in range(4000))
    assert len(paths(many)) == 4001
    assert paths("(" * 100_000 + "{" * 100_000) == ["preamble"] and paths("x = " * 100_000) == ["preamble"]


def test_code_is_chunked_under_its_members():
    kind = documents.media_type("a.tsx", b"class A {}")
    assert kind == "text/typescript"
    got = chunk.chunks(documents.blocks(b"class A {\n  f() { return 1 }\n  g() {}\n}\n", kind), chunk.PLANS[kind])
    assert [c["section"] for c in got] == ["preamble", "A > f", "A > g"] and got[2]["text"] == "A > g\n\n  g() {}"

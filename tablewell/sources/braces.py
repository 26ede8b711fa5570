"""Source code of languages with braces (JavaScript, TypeScript, Kotlin, C#) as a block for each function or member.

Three steps, each linear in the text. A lexer blanks comments, strings, templates and regular expressions, so that no
brace within them counts. Brackets are paired, and each container (the file, a class) is read as its own text alone, what
is nested in its brackets left out. Declarations are found in that text by their heads.

Odd cases: an empty file has no block, a file without declarations is one preamble; a string or comment that isn't closed
ends with its line or the text; brackets that don't pair are passed over; classes nested over `DEEPEST` levels aren't
opened, their text goes with its surroundings. No line is lost but those at the end that only close braces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from .blocks import Block

DEEPEST = 50
NAME = r"[^\W\d][\w$]*|\$[\w$]*"


@dataclass(frozen=True)
class Literal:
    """What opens and ends a literal, what escapes in it, what opens code in it, and whether a line's end ends it."""

    opener: str
    closer: str
    escape: str = "\\"
    code: str = ""
    line: bool = False


# The literals of each language, longer openers first.
LITERALS = {
    "script": (Literal("`", "`", code="${"), Literal('"', '"', line=True), Literal("'", "'", line=True)),
    "kotlin": (Literal('"""', '"""', escape="", code="${"), Literal('"', '"', code="${", line=True), Literal("'", "'", line=True)),
    "csharp": (
        Literal('$"""', '"""', escape="", code="{"), Literal('"""', '"""', escape=""),
        Literal('$@"', '"', escape='"', code="{"), Literal('@$"', '"', escape='"', code="{"), Literal('@"', '"', escape='"'),
        Literal('$"', '"', code="{", line=True), Literal('"', '"', line=True), Literal("'", "'", line=True),
    ),
}
# Words of JavaScript after which a slash begins a regular expression.
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "await", "yield", "instanceof"}
_PATTERN = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\\\]\n]|\\[^\n])*\])+/\w*")


def _is_pattern(text: str, at: int) -> bool:
    """Whether the slash at `at` begins a regular expression, by what stands before it."""
    before = text[max(0, at - 200) : at].rstrip()
    word = re.search(r"[\w$]+$", before)
    return word.group() in BEFORE_PATTERN if word else not before.endswith((")", "]", '"'))


def blanked(text: str, language: str) -> str:
    """The text at its length, with comments and literals as spaces; a quote stays where a literal begins."""
    literals = LITERALS[language]
    starts = re.compile("|".join(["//", r"/\*", "/", "[{}]", *(re.escape(x.opener) for x in literals)]))
    by_opener = {x.opener: x for x in literals}
    out: list[str] = []
    # the code that encloses: how many braces are open in it, and the literal that it stands in
    within: list[tuple[int, Literal]] = []
    depth, at = 0, 0

    def put(begin: int, end: int, blank: bool, mark: str = "") -> None:
        part = text[begin:end]
        if blank or within:
            part = re.sub(r"[^\n]", " ", part)
            part = mark + part[len(mark) :] if mark and not within else part
        out.append(part)

    def literal(begin: int, kind: Literal, mark: str) -> int:
        """Blanks up to the literal's end, or to code in it; where to go on."""
        nonlocal depth
        stops = [re.escape(kind.closer), *([re.escape(kind.code)] if kind.code else []), *(["\n"] if kind.line else []), *([r"\\[\s\S]"] if kind.escape == "\\" else [])]
        if kind.escape == '"':
            stops.insert(0, '""')
        if kind.code == "{":
            stops.insert(0, r"\{\{")
        seek, where = re.compile("|".join(stops)), begin + (len(kind.opener) if mark else 0)
        while m := seek.search(text, where):
            where = m.end()
            if m.group() == kind.code:
                put(begin, where, True, mark)
                within.append((depth, kind))
                depth = 0
                return where
            if m.group() in (kind.closer, "\n"):
                put(begin, where, True, mark)
                return where
        put(begin, len(text), True, mark)
        return len(text)

    while m := starts.search(text, at):
        put(at, m.start(), False)
        at, token = m.start(), m.group()
        if token == "//":
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            put(at, end, True)
        elif token == "/*":
            end = _comment_end(text, at, language == "kotlin")
            put(at, end, True)
        elif token == "/":
            found = _PATTERN.match(text, at) if language == "script" and _is_pattern(text, at) else None
            end = found.end() if found else at + 1
            put(at, end, bool(found), '"' if found else "")
        elif token == "{":
            depth, end = depth + 1, at + 1
            put(at, end, False)
        elif token == "}" and within and not depth:
            put(at, at + 1, True)
            depth, kind = within.pop()
            end = literal(at + 1, kind, "")
        elif token == "}":
            depth, end = max(0, depth - 1), at + 1
            put(at, end, False)
        else:
            end = literal(at, by_opener[token], '"')
        at = end
    put(at, len(text), False)
    return "".join(out)


def _comment_end(text: str, at: int, nests: bool) -> int:
    open_, where = 0, at
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        open_ += (1 if nests or not open_ else 0) if m.group() == "/*" else -1
        where = m.end()
        if not open_:
            return where
    return len(text)


def _pairs(code: str) -> dict[int, int]:
    """Where each bracket is closed; a bracket that isn't closed within its own is left out."""
    closers, held, out = {")": "(", "]": "[", "}": "{"}, [], {}
    waiting = {"(": 0, "[": 0, "{": 0}
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m.group()
        if c in waiting:
            held.append((c, m.start()))
            waiting[c] += 1
        elif waiting[closers[c]]:
            while True:
                kind, begin = held.pop()
                waiting[kind] -= 1
                if kind == closers[c]:
                    out[begin] = m.start()
                    break
    return out


class Own:
    """The text of a container without what its brackets hold, and where each character of it stood."""

    def __init__(self, code: str, pairs: dict[int, int], begin: int, end: int):
        parts, self.sizes, self.places, size, at = [], [], [], 0, begin
        bracket = re.compile(r"[(\[{]")
        while True:
            m = bracket.search(code, at, end)
            stop = m.start() + 1 if m else end
            self.sizes.append(size)
            self.places.append(at)
            parts.append(code[at:stop])
            size += stop - at
            if not m:
                break
            at = min(pairs.get(m.start(), stop), end)
        self.text = "".join(parts)

    def place(self, at: int) -> int:
        k = bisect_right(self.sizes, at) - 1
        return self.places[k] + at - self.sizes[k]


Symbol = tuple[int, int, list[str]]
_GENERIC = r"(?:\s*<[^(){};]{0,300}>)?"
# Words that look like a called or declared name and aren't.
NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "new", "using", "lock", "fixed", "foreach", "when", "await", "throw", "else", "super", "do", "with", "nameof", "typeof", "constructor"}

_SCRIPT_CONTAINER = re.compile(rf"\b(?:class|namespace|module)\b(?:[ \t]+(?!extends\b|implements\b)(?P<name>{NAME}))?[^{{}};=()]{{0,400}}(?:\(\)[^{{}};=()]{{0,200}})?\{{(?=\}})")
_SCRIPT_FUNCTION = re.compile(rf"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\basync\s+)?\bfunction\b\s*\*?\s*(?P<name>{NAME})?{_GENERIC}\s*\(\)[^{{}};]{{0,300}}(?:\{{\}}[^{{}};\n]{{0,60}})?\{{\}}")
_SCRIPT_VALUE = re.compile(rf"(?:\bexport\s+)?\b(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=;]{{0,300}}(?:=>[^=;]{{0,200}})?)?=\s*(?:async\b\s*)?(?:function\b|{_GENERIC}\s*\(\)[^={{}};]{{0,200}}(?:\{{\}}\s*)?=>|(?:{NAME})\s*=>)")
_SCRIPT_METHOD = re.compile(rf"^[ \t]*(?:(?:@[\w.]+(?:\(\))?|public|private|protected|static|override|readonly|abstract|async|get|set)\s+)*\*?\s*(?P<name>#?(?:{NAME})|\[\]){_GENERIC}\s*\(\)(?:\s*:[^;{{}}=]{{0,300}}(?:\{{\}}[ \t]*)?)?\s*\{{\}}", re.M)
_SCRIPT_FIELD = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|override|readonly)\s+)*(?P<name>#?(?:{NAME}))\s*(?::[^=;]{{0,300}})?=\s*(?:async\b\s*)?(?:function\b|{_GENERIC}\s*\(\)[^={{}};]{{0,200}}=>|(?:{NAME})\s*=>)", re.M)

_KOTLIN_CONTAINER = re.compile(rf"\b(?:(?P<companion>companion\s+object)|class|interface|object)\b(?:[ \t]+(?P<name>{NAME}))?{_GENERIC}(?:[^{{}}()=;\n]|\(\)|(?<=[:,])\s*\n){{0,400}}\{{(?=\}})")
_KOTLIN_FUNCTION = re.compile(rf"(?:\b\w+[ \t]+)*\bfun\b{_GENERIC}\s*(?:[\w.<>?,* ]{{0,200}}\.)?(?P<name>{NAME}|`[^`\n]+`){_GENERIC}\s*\(\)")
_KOTLIN_BUILD = re.compile(r"(?:\b\w+[ \t]+)*\b(?P<name>constructor)\s*\(\)(?:\s*:\s*(?:this|super)\s*\(\))?\s*(?:\{\})?")
_KOTLIN_VALUE = re.compile(rf"(?:\b\w+[ \t]+)*\b(?:val|var)\s+(?P<name>{NAME})\s*(?::[^={{}};\n]{{0,300}})?=\s*(?=\{{|fun\b)")
_KOTLIN_BODY = re.compile(r"(?:\s*:\s*[^={};\n]{1,300})?(?:\s*where\s[^={};]{1,300})?\s*(?:(?P<block>\{\})|(?P<value>=(?!=)))")

_CSHARP_CONTAINER = re.compile(rf"\b(?:(?P<space>namespace)|class|struct|interface|record(?:\s+(?:class|struct))?)\s+(?P<name>{NAME})[\w.]*{_GENERIC}[^{{}};=]{{0,400}}\{{(?=\}})")
_CSHARP_MEMBER = re.compile(
    rf"""^[ \t]*(?:\[\]\s*)*(?:(?P<destructor>~)|(?:[\w.?,]+{_GENERIC}(?:\[\])?\??\s+|\(\)\??\s+)*?)
    (?:(?P<operator>operator)\s*(?:true\b|false\b|[\w.?]+|[^\w\s(]{{1,3}})|(?P<index>this)\s*\[\]|(?P<name>(?:[\w.]+\.)?(?:{NAME}))){_GENERIC}
    (?P<call>\s*\(\))?(?:\s*:\s*(?:base|this)\s*\(\))?(?:\s*where\s[^{{}};=]{{1,300}})?\s*(?:(?P<block>\{{\}})|(?P<value>=>))""",
    re.M | re.X,
)
# Words that open a type or statement of C#, not a member.
CSHARP_OTHER = re.compile(r"\b(?:class|struct|interface|record|enum|namespace|return|new|await|throw|if|else|for|foreach|while|switch|using|lock|try|do|catch|finally|get|set|init|add|remove|delegate|unsafe\s*\{)\b")


def _value_end(text: str, at: int, needs_semicolon: bool) -> int:
    """Where the expression that begins at `at` ends: at a semicolon, else at a line's end after which none goes on."""
    at += len(text[at:]) - len(text[at:].lstrip()) if text[at : at + 1].isspace() else 0
    m = re.compile(r";" if needs_semicolon else r";|\n(?!\s*(?:[.?:&|+*/,=<>)%^-]|else\b))").search(text, at)
    return m.start() + (m.group() == ";") if m else len(text)


def _script(own: Own, parents: list[str], code: str, pairs: dict[int, int]) -> Iterator[tuple[int, int, str]]:
    heads = [_SCRIPT_METHOD, _SCRIPT_FIELD] if parents else [_SCRIPT_FUNCTION, _SCRIPT_VALUE]
    for head in heads:
        for m in head.finditer(own.text):
            name, end = m["name"] or "default", m.end()
            if name in NOT_NAMES - {"constructor"}:
                continue
            if head in (_SCRIPT_VALUE, _SCRIPT_FIELD):
                body = re.compile(r"\s*\{\}").match(own.text, end) if own.text[end - 2 : end] == "=>" else None
                end = body.end() if body else _value_end(own.text, end, False)
            yield m.start(), end, name


def _kotlin(own: Own, parents: list[str], code: str, pairs: dict[int, int]) -> Iterator[tuple[int, int, str]]:
    for m in _KOTLIN_FUNCTION.finditer(own.text):
        body = _KOTLIN_BODY.match(own.text, m.end())
        line = own.text.find("\n", m.end())
        end = (_value_end(own.text, body.end(), False) if body["value"] else body.end()) if body else len(own.text) if line < 0 else line
        yield m.start(), end, m["name"].strip("`")
    for m in _KOTLIN_VALUE.finditer(own.text):
        yield m.start(), _value_end(own.text, m.end(), False), m["name"]
    if parents:
        yield from ((m.start(), m.end(), m["name"]) for m in _KOTLIN_BUILD.finditer(own.text) if not own.text[: m.start()].rstrip().endswith("class"))


def _csharp(own: Own, parents: list[str], code: str, pairs: dict[int, int]) -> Iterator[tuple[int, int, str]]:
    for m in _CSHARP_MEMBER.finditer(own.text):
        if CSHARP_OTHER.search(m.group()) or m["name"] in NOT_NAMES:
            continue
        if m["block"] and not (m["call"] or m["operator"]):
            opens = own.place(m.start("block"))
            if not re.search(r"\{|=>", code[opens + 1 : pairs[opens]]):
                continue  # an automatic property
        last = parents[-1].rpartition(".")[2] if parents else ""
        name = "destructor" if m["destructor"] else "operator" if m["operator"] else "this" if m["index"] else m["name"].rpartition(".")[2]
        yield m.start(), m.end() if m["block"] else _value_end(own.text, m.end(), True), "constructor" if m["call"] and name == last else name


READERS = {"script": (_SCRIPT_CONTAINER, _script), "kotlin": (_KOTLIN_CONTAINER, _kotlin), "csharp": (_CSHARP_CONTAINER, _csharp)}


def symbols(text: str, language: str) -> list[Symbol]:
    """Beginning, end and path of each function or member, in order."""
    code = blanked(text, language)
    pairs = _pairs(code)
    container, reader = READERS[language]
    out: list[Symbol] = []
    open_: list[tuple[int, int, list[str], int]] = [(0, len(code), [], 0)]
    while open_:
        begin, end, parents, depth = open_.pop()
        own = Own(code, pairs, begin, end)
        for first, last, name in reader(own, parents, code, pairs):
            first += len(own.text[first:last]) - len(own.text[first:last].lstrip())
            out.append((own.place(first), own.place(last - 1) + 1, [".".join(parents), name] if parents else [name]))
        for m in container.finditer(own.text) if depth < DEEPEST else ():
            opens = own.place(m.end() - 1)
            if opens not in pairs:
                continue
            groups = m.groupdict()
            name = m["name"] or ("Companion" if groups.get("companion") else "default")
            open_.append((opens + 1, pairs[opens], parents if groups.get("space") else [*parents, name], depth + 1))
    return sorted(out, key=lambda s: (s[0], -s[1]))


def brace_code(text: str, language: str) -> list[Block]:
    """A block for each function and member, with the lines since the one before it; the first lines are the preamble, the last the epilogue.

    Annotations and attributes above the first member go with it; lines that two declarations share aren't repeated.
    """
    lines = text.split("\n")
    found = symbols(text, language)
    begins = [0]
    for line in lines:
        begins.append(begins[-1] + len(line) + 1)
    row = lambda at: bisect_right(begins, at) - 1
    out: list[Block] = []
    at = 0

    def put(first: int, last: int, path: list[str]) -> None:
        if (part := "\n".join(lines[first:last]).strip("\n")).strip():
            out.append(Block(part, path, kind="code"))

    for begin, end, path in found:
        first, last = row(begin), row(end - 1) + 1
        if first < at:
            continue
        if not at:
            while first > 0 and re.match(r"\s*(?:@[\w.:]+(?:\(.*\))?|\[[^\]]*\])\s*$", lines[first - 1]):
                first -= 1
            put(0, first, ["preamble"])
            at = first
        put(at, last, path)
        at = last
    if not found:
        put(0, len(lines), ["preamble"])
    elif re.search(r"[^\s{}();]", "\n".join(lines[at:])):
        put(at, len(lines), ["epilogue"])
    return out

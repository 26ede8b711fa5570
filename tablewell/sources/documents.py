"""Documents of several formats as blocks of text."""

from __future__ import annotations

import ast
import csv
import io
import re
from html.parser import HTMLParser

from .blocks import Block
from .braces import brace_code
from .delimited import MOST_FIELDS, separator_of
from .office import Parts, declared_title, docx, parts_of, pptx

# Extensions and media types.
EXTENSIONS = {
    "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "tsv": "text/tab-separated-values",
    "pdf": "application/pdf", "py": "text/x-python", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "js": "text/javascript", "jsx": "text/javascript", "mjs": "text/javascript", "cjs": "text/javascript",
    "ts": "text/typescript", "tsx": "text/typescript", "mts": "text/typescript", "cts": "text/typescript",
    "kt": "text/x-kotlin", "kts": "text/x-kotlin", "cs": "text/x-csharp",
}
# The lexer of each media type of code with braces.
BRACES = {"text/javascript": "script", "text/typescript": "script", "text/x-kotlin": "kotlin", "text/x-csharp": "csharp"}
MOST_RECORDS = 10_000


def media_type(filename: str, content: bytes, declared: str | None = None, override: str | None = None) -> str:
    """Override, declared type or extension, in this order; ValueError if the bytes look otherwise."""
    own = declared if declared not in (None, "", "application/octet-stream") else None
    kind = override or own or EXTENSIONS.get(filename.rpartition(".")[2].lower(), "text/plain")
    kind = kind.split(";")[0].strip().lower()
    shape = "pdf" if content[:5] == b"%PDF-" else "zip" if content[:4] == b"PK\x03\x04" else "binary" if b"\0" in content[:4096] else "text"
    wanted = "pdf" if kind == "application/pdf" else "zip" if "openxmlformats" in kind else "text"
    if shape != wanted:
        raise ValueError(f"{filename} is said to be {kind}, but its bytes are {shape}")
    return kind


def paragraphs(text: str) -> list[Block]:
    return [Block(p.strip()) for p in re.split(r"\n\s*\n", text) if p.strip()]


def markdown(text: str) -> list[Block]:
    """A block for each paragraph, under the headings that hold for it; headings in code fences are none."""
    out: list[Block] = []
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    fenced = False

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append(Block(body, [h for _, h in path]))
        lines.clear()

    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            close()
            path = [p for p in path if p[0] < len(m[1])] + [(len(m[1]), m[2])]
        elif not line.strip() and not fenced:
            close()
        else:
            lines.append(line)
    close()
    return out


# Elements whose content isn't shown, and elements that stand on lines of their own.
UNSEEN = frozenset(("head", "noscript", "script", "style", "template"))
ON_THEIR_OWN = frozenset(("article", "blockquote", "body", "div", "footer", "form", "header", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul"))


class _PageReader(HTMLParser):
    """Collects a page's blocks: the text between two block elements, under the headings that hold for it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.path: list[tuple[int, str]] = []
        self.lines: list[str] = [""]
        self.level = 0
        self.unseen: str | None = None
        self.depth = 0

    def finish(self) -> None:
        """End the block, or the heading, that was being read."""
        lines = [" ".join(x.split()) for x in self.lines]
        text = "\n".join(x for x in lines if x and x != "-")
        self.lines = [""]
        if text and self.level:
            self.path = [h for h in self.path if h[0] < self.level] + [(self.level, text.replace("\n", " "))]
        elif text:
            self.blocks.append(Block(text, [h for _, h in self.path]))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.unseen:
            self.depth += tag == self.unseen
        elif tag in UNSEEN:
            self.unseen, self.depth = tag, 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.finish()
            self.level = int(tag[1])
        elif tag in ON_THEIR_OWN:
            self.finish()
            self.level = 0
        elif tag == "br":
            self.lines.append("")
        elif tag == "li":
            self.lines.append("- ")
        elif tag in ("td", "th"):
            self.lines[-1] += " "

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            self.depth -= tag == self.unseen
            self.unseen = self.unseen if self.depth else None
        elif tag in ON_THEIR_OWN or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.finish()
            self.level = 0

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.lines[-1] += data


def page(text: str) -> list[Block]:
    reader = _PageReader()
    reader.feed(text)
    reader.close()
    reader.finish()
    return reader.blocks


def records(text: str) -> list[dict[str, str | None]]:
    """The records of a delimited text by its header: short ones are filled up with None, blank lines are dropped."""
    lines = [x for x in csv.reader(io.StringIO(text), delimiter=separator_of(next((x for x in text.split("\n") if x.strip()), ""))) if any(f.strip() for f in x)]
    if not lines:
        raise ValueError("a delimited file needs a header")
    if len(lines[0]) > MOST_FIELDS or len(lines) > MOST_RECORDS + 1:
        raise ValueError(f"a delimited document has at most {MOST_FIELDS} fields and {MOST_RECORDS} records")
    names = [name.strip() or f"column_{k}" for k, name in enumerate(lines[0], 1)]
    return [dict(zip(names, [*line, *[None] * len(names)], strict=False)) for line in lines[1:]]


def table_rows(text: str) -> list[Block]:
    """A block for each record of a delimited text: a line `name: value` for each field that has a value."""
    shown = ("\n".join(f"{n}: {v}" for n, v in r.items() if v) for r in records(text))
    return [Block(body, kind="table") for body in shown if body]


def python_code(text: str) -> list[Block]:
    """A block for each function and method, and what stands before, between and after them."""
    lines = text.split("\n")
    spans: list[tuple[int, int, list[str]]] = []

    def walk(body: list, path: list[str]) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                spans.append((first, node.end_lineno or first, [*path, node.name]))
            elif isinstance(node, ast.ClassDef):
                walk(node.body, [*path, node.name])

    try:
        walk(ast.parse(text).body, [])
    except SyntaxError:
        return paragraphs(text)
    out, at = [], 1
    for first, last, path in sorted(spans):
        before = "\n".join(lines[at - 1 : first - 1]).strip("\n")
        if before.strip():
            out.append(Block(before, ["preamble"] if at == 1 else path[:-1], kind="code"))
        out.append(Block("\n".join(lines[first - 1 : last]), path, kind="code"))
        at = last + 1
    rest = "\n".join(lines[at - 1 :]).strip("\n")
    return [*out, Block(rest, ["epilogue"], kind="code")] if rest.strip() else out


def opened(content: bytes, kind: str) -> bytes | Parts:
    """A document as `blocks` and `title` both take it, so that an archive's directory is read once for the two."""
    return parts_of(content) if "openxmlformats" in kind else content


def blocks(content: bytes | Parts, kind: str) -> list[Block]:
    """The blocks of a document of a media type."""
    if kind.endswith("wordprocessingml.document"):
        return docx(content)
    if kind.endswith("presentationml.presentation"):
        return pptx(content)
    if kind == "application/pdf":
        raise ValueError("this library reads no PDF")
    text = content.decode("utf-8", "replace").replace("\r\n", "\n")
    if kind in BRACES:
        return brace_code(text, BRACES[kind])
    readers = {"text/html": page, "text/markdown": markdown, "text/x-python": python_code, "text/csv": table_rows, "text/tab-separated-values": table_rows}
    return readers.get(kind, paragraphs)(text)


def title(content: bytes | Parts, kind: str, found: list[Block]) -> str | None:
    """The title that an office document declares, else the first heading of a document's blocks."""
    declared = declared_title(content) if "openxmlformats" in kind else None
    return declared or next((b.headings[0] for b in found if b.headings), None)

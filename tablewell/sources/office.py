"""Word documents and slide decks as blocks of text.

Both are archives of XML. A reader takes one part's tags in turn and is asked for local names only, so that prefixes don't
matter. Text that a part holds twice (a fallback for older readers) or no longer (deleted, moved away) is left out.
"""

from __future__ import annotations

import codecs
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable
from functools import lru_cache, wraps
from html import unescape
from html.parser import HTMLParser

from .blocks import Block

MOST_UNPACKED = 200 << 20
MOST_TAGS, MOST_CHARS = 1 << 12, 256  # tags kept taken apart, and the characters of each
MOST_PARTS, MOST_PART = 1 << 12, 1 << 12  # short parts whose reading is kept, since many documents hold the same, and the characters of each
UNPLAIN = 0x61  # flags of an entry: encrypted, patched, strongly encrypted
# Elements whose text isn't part of the document, and placeholders that repeat on every slide.
LEFT_OUT = frozenset(("del", "fallback", "movefrom"))
FURNITURE = frozenset(("dt", "ftr", "hdr", "sldnum"))
TITLES = frozenset(("ctrtitle", "title"))
# Elements within which HTML reads no tags, or others than XML.
HTML_OWN = frozenset(("iframe", "noembed", "noframes", "noscript", "plaintext", "script", "style", "textarea", "title", "xmp"))


class Parts:
    """The parts of an archive by name. A part that is stored as its entry says is unpacked from the bytes at once; any other
    is left to zipfile, which reads it or says why it can't."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.entries = self.zip.NameToInfo
        if sum(i.file_size for i in self.zip.infolist()) > MOST_UNPACKED:
            raise ValueError("the document unpacks to too much")

    def read(self, name: str) -> bytes:
        entry, content = self.entries[name], self.content
        at, raw = entry.header_offset, name.encode("ascii", "replace")
        head = content[at : at + 30 + len(raw)]
        if head[:4] == b"PK\3\4" and head[26:28] == len(raw).to_bytes(2, "little") and head[30:] == raw and not entry.flag_bits & UNPLAIN:
            at += len(head) + int.from_bytes(head[28:30], "little")
            data = content[at : at + entry.compress_size]
            try:
                if entry.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompressobj(-15).decompress(data, entry.file_size + 1)
            except zlib.error:
                data = b""
            if entry.compress_type in (zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED) and len(data) == entry.file_size and zlib.crc32(data) == entry.CRC:
                return data
        return self.zip.read(name)

    def xml(self, name: str) -> str | None:
        return self.read(name).removeprefix(codecs.BOM_UTF8).decode("utf-8", "replace") if name in self.entries else None


def parts_of(content: bytes | Parts) -> Parts:
    return content if isinstance(content, Parts) else Parts(content)


_PLAIN = re.compile(r"""(/?)([a-zA-Z][a-zA-Z0-9._:-]*)((?:[ \t\r\n]+[a-zA-Z_][a-zA-Z0-9._:-]*=(?:"[^"]*"|'[^']*'))*)[ \t\r\n]*(/?)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][a-zA-Z0-9._:-]*)=(?:"([^"]*)"|'([^']*)')""")


def _tag(inner: str) -> tuple[bool, bool, str, dict[str, str]] | None:
    """Of what stands between < and >: whether it opens and closes an element, its local name and attributes. None if it isn't
    a plain tag of XML, which HTML's parser would read alike."""
    if inner[:1] == "?":
        return False, False, "", {}
    m = _PLAIN.fullmatch(inner)
    if not m or m[2].lower() in HTML_OWN or (m[1] and (m[3] or m[4])):
        return None
    at = {k.lower().rpartition(":")[2]: unescape(a or b) for k, a, b in _ATTRIBUTE.findall(m[3])}
    return not m[1], bool(m[1] or m[4]), m[2].lower().rpartition(":")[2], at


def _kept(read: Callable) -> Callable:
    """Reads a short part once as long as it's among the last ones; what is returned must not be changed."""
    again = lru_cache(MOST_PARTS)(read)
    return wraps(read)(lambda xml: again(xml) if len(xml) <= MOST_PART else read(xml))


class _Lenient(HTMLParser):
    """HTML's parser, giving a reader what it finds."""

    def __init__(self, reader: _Tags) -> None:
        super().__init__(convert_charrefs=True)
        self.reader = reader

    def handle_starttag(self, tag: str, attrs: list) -> None:
        name = tag.rpartition(":")[2]
        self.reader.left_out += name in LEFT_OUT
        if not self.reader.left_out and (call := self.reader.methods(name)[0]):
            call(self.reader, {k.rpartition(":")[2]: v or "" for k, v in attrs})

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag.rpartition(":")[2] not in LEFT_OUT:
            super().handle_startendtag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        name = tag.rpartition(":")[2]
        if self.reader.left_out:
            self.reader.left_out -= name in LEFT_OUT
        elif call := self.reader.methods(name)[1]:
            call(self.reader)

    def handle_data(self, data: str) -> None:
        if not self.reader.left_out:
            self.reader.said(data)


class _Tags:
    """Calls `opened_x(attributes)` and `closed_x()` for elements x (`opened_other`, `closed_other` for those without methods of
    their own), and `said(text)`; local names are in lower case.

    Plain tags are read here, and each different one is taken apart once. From the first one that isn't plain (a comment, a
    declaration, broken markup) HTML's parser reads on: it is lenient and, like this, never resolves an entity that a part
    declares, but slow.
    """

    opened_other = closed_other = None
    SPAN = 1 << 16
    known: dict[str, tuple | None]

    def __init_subclass__(cls) -> None:
        cls.known = {}

    def __init__(self) -> None:
        self.left_out = 0

    def read(self, xml: str) -> None:
        at = self._plain(xml)
        if at < len(xml):
            rest = _Lenient(self)
            rest.feed(xml[at:])
            rest.close()

    @classmethod
    def methods(cls, name: str) -> tuple[Callable | None, Callable | None]:
        return getattr(cls, f"opened_{name}", cls.opened_other), getattr(cls, f"closed_{name}", cls.closed_other)

    @classmethod
    def _learnt(cls, inner: str) -> tuple[Callable | None, Callable | None, dict[str, str], int] | None:
        """What to call for a tag, its attributes, and by how much it changes what is left out."""
        made = _tag(inner)
        if made:
            begins, ends, name, at = made
            opened, closed = cls.methods(name) if not (begins and ends and name in LEFT_OUT) else (None, None)
            made = (opened if begins else None, closed if ends else None, at, (begins - ends) * (name in LEFT_OUT))
        if len(inner) <= MOST_CHARS:
            if len(cls.known) >= MOST_TAGS:
                cls.known.clear()
            cls.known[inner] = made
        return made

    def _plain(self, xml: str) -> int:
        """Reads a span of tags after the other, as long as they are plain; returns where it stopped."""
        at, out, known, learnt, said = xml.find("<"), 0, self.known, self._learnt, self.said
        if at < 0:
            return 0
        if at:
            said(unescape(xml[:at]))
        while at < len(xml):
            end = len(xml)
            if end - at > self.SPAN:
                end = xml.rfind("<", at + 1, at + self.SPAN)
                end = xml.find("<", at + self.SPAN) if end < 0 else end
                end = len(xml) if end < 0 else end
            pieces = xml[at + 1 : end].split("<")
            for k, piece in enumerate(pieces):
                inner, ended, text = piece.partition(">")
                tag = known[inner] if inner in known else learnt(inner)
                if tag is None or not ended:
                    self.left_out = out
                    return at + sum(map(len, pieces[:k])) + k
                begins, ends, attributes, change = tag
                if change and (out or change > 0):
                    out += change
                    begins = ends = None
                if out:
                    continue
                if begins:
                    begins(self, attributes)
                if ends:
                    ends(self)
                if text:
                    said(unescape(text) if "&" in text else text)
            at = end
        self.left_out = out
        return at

    def said(self, text: str) -> None: ...


class _Paragraphs(_Tags):
    """Paragraphs of runs, and tables as lines of cells; `paragraph` and `table` are called as each of them ends.

    A paragraph within another one (a text box) comes before it; a table within a cell becomes the cell's text.
    """

    def __init__(self) -> None:
        super().__init__()
        self.open: list[list[str]] = []
        self.tables: list[list[list[list[str]]]] = []
        self.in_text = self.in_run = 0

    def opened_p(self, at: dict[str, str]) -> None:
        self.open.append([])

    def opened_t(self, at: dict[str, str]) -> None:
        self.in_text += 1

    def opened_r(self, at: dict[str, str]) -> None:
        self.in_run += 1

    def opened_tbl(self, at: dict[str, str]) -> None:
        self.tables.append([])

    def opened_tr(self, at: dict[str, str]) -> None:
        if self.tables:
            self.tables[-1].append([])

    def opened_tc(self, at: dict[str, str]) -> None:
        if self.tables and self.tables[-1]:
            self.tables[-1][-1].append([])

    def opened_br(self, at: dict[str, str]) -> None:
        if self.open:
            self.open[-1].append("\n")

    opened_cr = opened_br

    def opened_tab(self, at: dict[str, str]) -> None:
        if self.open and self.in_run:
            self.open[-1].append("\t")

    def closed_t(self) -> None:
        if self.in_text:
            self.in_text -= 1

    def closed_r(self) -> None:
        if self.in_run:
            self.in_run -= 1

    def closed_p(self) -> None:
        if self.open:
            self._placed("".join(self.open.pop()).strip(), self.paragraph)

    def closed_tbl(self) -> None:
        if self.tables:
            rows = [" | ".join([" ".join(" ".join(cell).split()) for cell in row]) for row in self.tables.pop()]
            self._placed("\n".join(r for r in rows if r.strip(" |")), self.table)

    def _placed(self, text: str, whole) -> None:  # noqa: ANN001
        if self.tables and self.tables[-1] and self.tables[-1][-1]:
            self.tables[-1][-1][-1].append(text)
        else:
            whole(text)

    def said(self, text: str) -> None:
        if self.in_text and self.open:
            self.open[-1].append(text)
        elif self.in_text and text.strip():  # outside of a paragraph
            self._placed(text.strip(), self.paragraph)

    def paragraph(self, text: str) -> None: ...

    def table(self, text: str) -> None: ...


class _Styles(_Tags):
    """The heading level of each style: by its name, or by its level in the outline."""

    def __init__(self) -> None:
        super().__init__()
        self.level: dict[str, int] = {}
        self.style = ""

    def opened_style(self, at: dict[str, str]) -> None:
        self.style = at.get("styleid", "")

    def opened_name(self, at: dict[str, str]) -> None:
        if m := re.fullmatch(r"heading ([1-9])", at.get("val", ""), re.I):
            self.level[self.style] = int(m[1])

    def opened_outlinelvl(self, at: dict[str, str]) -> None:
        if at.get("val", "") in tuple("012345678"):
            self.level.setdefault(self.style, int(at["val"]) + 1)


@_kept
def _levels(xml: str) -> dict[str, int]:
    styles = _Styles()
    styles.read(xml)
    return styles.level


class _Word(_Paragraphs):
    """Blocks of a document: paragraphs and tables under the headings that hold for them."""

    def __init__(self, levels: dict[str, int]) -> None:
        super().__init__()
        self.levels = levels
        self.blocks: list[Block] = []
        self.path: list[tuple[int, str]] = []
        self.kinds: list[dict[str, int]] = []

    def opened_p(self, at: dict[str, str]) -> None:
        self.open.append([])
        self.kinds.append({})

    def opened_pstyle(self, at: dict[str, str]) -> None:
        value = at.get("val", "")
        named = re.fullmatch(r"heading ?([1-9])", value, re.I)
        level = self.levels.get(value, int(named[1]) if named else 0)
        if level and self.kinds:
            self.kinds[-1].setdefault("level", level)

    def opened_outlinelvl(self, at: dict[str, str]) -> None:
        if self.kinds and at.get("val", "") in tuple("012345678"):
            self.kinds[-1]["level"] = int(at["val"]) + 1

    def opened_ilvl(self, at: dict[str, str]) -> None:
        if self.kinds and at.get("val", "").isdigit():
            self.kinds[-1]["depth"] = int(at["val"])

    def opened_numid(self, at: dict[str, str]) -> None:
        if self.kinds and at.get("val", "") != "0":
            self.kinds[-1]["item"] = 1

    def closed_p(self) -> None:
        super().closed_p()
        if self.kinds:
            self.kinds.pop()

    def paragraph(self, text: str) -> None:
        kind = self.kinds[-1] if self.kinds else {}
        if text and "level" in kind:
            self.path = [h for h in self.path if h[0] < kind["level"]] + [(kind["level"], " ".join(text.split()))]
        elif text:
            mark = "  " * kind.get("depth", 0) + "- " if "item" in kind else ""
            self.blocks.append(Block(mark + text, [h for _, h in self.path]))

    def table(self, text: str) -> None:
        if text:
            self.blocks.append(Block(text, [h for _, h in self.path], kind="table"))


def docx(content: bytes | Parts) -> list[Block]:
    """A block for each paragraph and each table, a line `cell | cell` for each of its rows; `- ` before items of lists.

    A heading is a paragraph whose style is one, by the style's name or level, or that has a level in the outline itself.
    """
    parts = parts_of(content)
    xml = parts.xml("word/document.xml")
    if xml is None:
        raise ValueError("this archive holds no Word document")
    reader = _Word(_levels(parts.xml("word/styles.xml") or ""))
    reader.read(xml)
    return reader.blocks


class _Slide(_Paragraphs):
    """The title of a slide, and the text of its other shapes in their order."""

    def __init__(self) -> None:
        super().__init__()
        self.title = ""
        self.shapes: list[list[str]] = [[]]
        self.role = ""

    def opened_sp(self, at: dict[str, str]) -> None:
        self.role = ""
        self.shapes.append([])

    opened_graphicframe = opened_sp

    def opened_ph(self, at: dict[str, str]) -> None:
        self.role = at.get("type", "").lower()

    def closed_sp(self) -> None:
        self.role = ""
        self.shapes.append([])

    closed_graphicframe = closed_sp

    def paragraph(self, text: str) -> None:
        if self.role in TITLES:
            self.title = " ".join([*self.title.split(), *text.split()])
        elif text and self.role not in FURNITURE:
            self.shapes[-1].append(text)

    table = paragraph

    def body(self) -> str:
        return "\n\n".join("\n".join(s) for s in self.shapes if s)


@_kept
def _slide(xml: str) -> tuple[str, str]:
    """Title and body of a slide or of notes."""
    reader = _Slide()
    reader.read(xml)
    return reader.title, reader.body()


class _Targets(_Tags):
    """Where the relationships of a part lead, by the last word of their type."""

    def __init__(self) -> None:
        super().__init__()
        self.of: dict[str, str] = {}

    def opened_relationship(self, at: dict[str, str]) -> None:
        if at.get("targetmode", "").lower() != "external":
            self.of.setdefault(at.get("type", "").rpartition("/")[2], at.get("target", ""))


@_kept
def _named_notes(links: str) -> str:
    targets = _Targets()
    targets.read(links)
    return posixpath.normpath(posixpath.join("/ppt/slides", targets.of.get("notesSlide", ""))).lstrip("/")


def _notes(parts: Parts, number: int) -> str:
    """What is said beside a slide. Notes are found by the slide's relationships; only a slide that has no such part may have
    notes of its own number."""
    links = parts.xml(f"ppt/slides/_rels/slide{number}.xml.rels")
    name = f"ppt/notesSlides/notesSlide{number}.xml" if links is None else _named_notes(links)
    return _slide(parts.xml(name) or "")[1]


def pptx(content: bytes | Parts) -> list[Block]:
    """A hard block for each slide in numeric order, under its title, its notes appended; a slide of a title only is that."""
    parts = parts_of(content)
    found = sorted(int(m[1]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", x) for x in parts.entries) if m)
    if not found:
        raise ValueError("this archive holds no slides")
    out = []
    for number in found:
        title, body = _slide(parts.xml(f"ppt/slides/slide{number}.xml") or "")
        said = _notes(parts, number)
        text = "\n\n".join(x for x in (body, f"Speaker notes: {said}" if said else "") if x)
        if text or title:
            out.append(Block(text or title, [title] if title and text else [], page=number, hard=True))
    return out


class _Core(_Tags):
    def __init__(self) -> None:
        super().__init__()
        self.title, self.inside = "", False

    def opened_title(self, at: dict[str, str]) -> None:
        self.inside = True

    def opened_other(self, at: dict[str, str]) -> None:
        self.inside = False

    def closed_other(self) -> None:
        self.inside = False

    def said(self, text: str) -> None:
        self.title += text if self.inside else ""


def declared_title(content: bytes | Parts) -> str | None:
    """The title in a document's properties; None if there is none."""
    core = _Core()
    core.read(parts_of(content).xml("docProps/core.xml") or "")
    return " ".join(core.title.split()) or None

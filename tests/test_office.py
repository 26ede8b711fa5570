"""Office documents are read quickly, and as the lenient parser reads them."""

import io
import random
import zipfile

import pyarrow as pa
import pytest

from tablewell.operators import ingest_files
from tablewell.plans import office as plan
from tablewell.sources import documents, office

LINES = [(k, k * 7, "RAN"[k % 3]) for k in range(1, 8)]
PLAIN = """<w:p> </w:p> <w:r> </w:r> <w:t> </w:t> <w:tbl> </w:tbl> <w:tr> </w:tr> <w:tc> </w:tc> <w:br/> <w:tab/> <w:del> </w:del> <mc:Fallback> </mc:Fallback> <w:del/> <W:P/> <p:sp> </p:sp>
<p:ph#type="title"/> <p:ph#type='sldNum'/> <w:pStyle#w:val="H1"/> <w:outlineLvl#w:val="1"/> <w:numId#w:val="3"/> <dc:title> </dc:title> word a#&lt;#b &#150; &nbsp é <?pi#a="b"?>""".replace("&#", "&\0").replace("#", " ").replace("\0", "#")
ODD = '<!--#<w:t>x#--> <![CDATA[#in#<b>#]]> <!DOCTYPE#x#[<!ENTITY#a#"b">]> <style> </style> <a#b="1>2"/> <a#b="x<y>z"> <a#b=c> <#b < > <w:t </ <é> &am <a#b="c"d="e">'


def seen(kind, xml):
    reader = office._Word({"H1": 1}) if kind == "word" else office._Slide() if kind == "slide" else office._Core()
    reader.read(xml)
    return reader.__dict__


@pytest.mark.parametrize("kind", ["word", "slide", "core"])
def test_plain_tags_are_read_as_the_lenient_parser_reads_them(monkeypatch, kind):
    rng, plain, odd = random.Random(7), [x.replace("#", " ") if "&#" not in x else x for x in PLAIN.split()], [x.replace("#", " ") for x in ODD.split()]
    for k in range(600):
        xml = "".join(rng.choice(odd if k % 3 == 0 and rng.random() < 0.05 else plain) for _ in range(rng.randrange(1, 70)))
        with monkeypatch.context() as m:
            m.setattr(office._Tags, "SPAN", rng.choice((1, 30, 1 << 16)))
            got = seen(kind, xml)
            m.setattr(office._Tags, "_plain", lambda self, xml: 0)
            assert got == seen(kind, xml), xml


def test_office_files_need_no_lenient_parser_and_one_look_at_the_directory(monkeypatch):
    opened, real = [], zipfile.ZipFile
    monkeypatch.setattr(office, "_Lenient", None)
    monkeypatch.setattr(zipfile, "ZipFile", lambda *a: opened.append(1) or real(*a))
    files = {"1.docx": plan._document(1, LINES), "1.pptx": plan._deck(LINES), "2.docx": b"PK\3\4 no archive", "3.docx": None}
    got = ingest_files._read(pa.array(list(files)), pa.array(list(files.values()), pa.binary())).to_pylist()
    assert len(opened) == 3  # two that are read, one that isn't an archive
    assert [(r["status"], r["title"], len(r["chunks"])) for r in got] == [("ready", "Order 1", 1), ("ready", "Line 1", 7), ("failed", None, 0), ("failed", None, 0)]
    assert got[0]["chunks"][0]["text"].split("\n")[2:4] == ["Line | Quantity | Flag", "1 | 7 | A"] and got[1]["chunks"][6]["text"] == "Line 7\n\nQuantity 49\n\nSpeaker notes: flag A"


def test_archives_are_those_of_zipfile():
    parts = {"a/b.xml": "<x>é</x>", "c.xml": "", "d.xml": "y" * 3000}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(zipfile.ZipInfo(name), xml)
    assert plan._archive(parts) == out.getvalue()


@pytest.mark.parametrize("how", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2])
def test_parts_are_those_of_zipfile(how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        z.writestr("word/document.xml", "﻿<w:p><w:r><w:t>one two three</w:t></w:r></w:p>" * 40)
        z.writestr("é.xml", "<x/>")
    whole = out.getvalue()
    parts = office.parts_of(b"before" + whole)
    assert all(parts.read(n) == parts.zip.read(n) for n in parts.entries) and parts.xml("word/document.xml").startswith("<w:p>")
    at = 30 + len("word/document.xml") + 5
    with pytest.raises(Exception, match="CRC|invalid|Bad|Invalid"):
        documents.docx(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :])


def test_files_and_chunks_of_office_documents(spark):
    files = spark.createDataFrame([("d/1.docx", 1, plan._document(1, LINES)), ("d/1.pptx", 2, plan._deck(LINES)), ("d/x.pptx", 3, b"text")], "path string, length long, content binary")
    table, parts = ingest_files.files_and_chunks(files)
    assert [(r.filename, r.status, r.pages, r.chunk_count, r.title) for r in table.orderBy("filename").collect()] == [("1.docx", "ready", None, 1, "Order 1"), ("1.pptx", "ready", 7, 7, "Line 1"), ("x.pptx", "failed", None, 0, None)]
    assert parts.count() == 8 and {r.page for r in parts.collect()} == {None, *range(1, 8)}

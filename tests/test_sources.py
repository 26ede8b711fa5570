"""Delimited files, documents, chunks and streams."""

import io
import json
import zipfile

import pytest

from tablewell.manifest import ColumnSpec
from tablewell.operators import chunk
from tablewell.operators.mapping import Field
from tablewell.sources import delimited, documents
from tablewell.sources.documents import Block
from tablewell.store import Store
from tablewell.streaming import ingest


def test_csv_types_are_strict(spark, tmp_path):
    lines = [
        "Ship (No.);Crew;crew;Draught;Moored;Berth;1st Port;Cargo id",
        "Ville;12;cook;7.25;false;003;40;-9007199254740992",
        '"Alma; II";;mate;8;true;117;-7;15',
        "Zora;3000;;-1e2;true;20;0;16",
    ]
    (tmp_path / "ships.csv").write_text("\n".join(lines) + "\n")
    got = delimited.inferred(delimited.read(spark, str(tmp_path / "ships.csv")))
    kinds = dict(ship_no="string", crew="int", crew_2="string", draught="double", moored="boolean", berth="string", c_1st_port="int", cargo_id="string")
    assert got.dtypes == list(kinds.items())
    want = [("Alma; II", None, "mate", 8.0, True, "117", -7, "15"), ("Ville", 12, "cook", 7.25, False, "003", 40, "-9007199254740992"), ("Zora", 3000, None, -100.0, True, "20", 0, "16")]
    assert [tuple(r) for r in got.orderBy("ship_no").collect()] == want


@pytest.mark.parametrize("header, want", [("a,b;c", ","), ("a;b;c", ";"), ("a\tb", "\t"), ("a", ","), ("a|b|c,d", "|")])
def test_separators(header, want):
    assert delimited.separator_of(header) == want


def test_media_types():
    assert documents.media_type("a.md", b"# x") == "text/markdown"
    assert documents.media_type("a.md", b"x", "text/html; charset=utf-8") == "text/html"
    with pytest.raises(ValueError):
        documents.media_type("a.pdf", b"plain text")
    with pytest.raises(ValueError):
        documents.media_type("a.txt", b"%PDF-1.7")


def test_markdown_and_html_keep_headings():
    got = documents.markdown("intro\n\n# A\none\n\n## B\ntwo\n```\n# no heading\n```\n# C\nthree")
    assert [(b.text.split("\n")[0], b.headings) for b in got] == [("intro", []), ("one", ["A"]), ("two", ["A", "B"]), ("three", ["C"])]
    page = documents.page("<html><head><title>t</title></head><script>x()</script><h1>Top &amp; more</h1><p>a<br>b</p><ul><li>c</ul>")
    assert page[0].headings == ["Top & more"] and "x()" not in "".join(b.text for b in page)


def test_pages_become_blocks_between_block_elements():
    got = documents.page("<body>lead &lt;in&gt;<h2>Part <em>one</em></h2><div>a <b>b</b><p>c</p>d</div><table><tr><td>1</td><td>2</td></tr></table><style>p{}</style><!-- no --><h1>Next</h1><ol><li>x<li>y</ol>tail")
    assert [(b.text, b.headings) for b in got] == [("lead <in>", []), ("a b", ["Part one"]), ("c", ["Part one"]), ("d", ["Part one"]), ("1 2", ["Part one"]), ("- x\n- y", ["Next"]), ("tail", ["Next"])]


def test_delimited_documents_become_a_block_for_each_record():
    got = documents.blocks(b'name;size;\n"a;b";1;x\n\nc\n', "text/csv")
    assert [(b.text, b.kind) for b in got] == [("name: a;b\nsize: 1\ncolumn_3: x", "table"), ("name: c", "table")]
    made = chunk.chunks(documents.blocks(b"k\tv\n" + b"".join(b"%d\tvalue %d\n" % (k, k) for k in range(60)), "text/tab-separated-values"), chunk.PLANS["text/tab-separated-values"])
    assert len(made) == 1 and made[0]["kind"] == "table" and made[0]["text"].startswith("k: 0\nv: value 0\n\nk: 1")
    with pytest.raises(ValueError):
        documents.records("  \n")


def test_long_blocks_are_cut_at_the_best_places_that_fit():
    assert chunk.fitting("aa aa\n\nbb. cc\n\n\ndd", 6) == ["aa aa", "bb. cc", "dd"]
    assert chunk.fitting("One two. Three\n\nfour! Five?", 8) == ["One two.", "Three", "four!", "Five?"]
    assert chunk.fitting("word " * 4, 7) == ["word wo", "rd word", " word "]
    assert (chunk.carried("some more words", 9), chunk.carried("x" * 20, 5), chunk.carried("short", 9)) == ("words", "xxxxx", "short")


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_office_documents():
    word = archive(word__document='<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:t>Title</w:t></w:p><w:p><w:r><w:t>a &lt; b</w:t></w:r></w:p>')
    assert documents.docx(word) == [Block("a < b", ["Title"])]
    slides = archive(ppt__slides__slide10="<a:p><a:t>ten</a:t></a:p>", ppt__slides__slide2="<a:p><a:t>two</a:t></a:p>", ppt__notesSlides__notesSlide2="<a:t>say it</a:t>")
    assert [(b.text, b.page, b.hard) for b in documents.pptx(slides)] == [("two\n\nSpeaker notes: say it", 2, True), ("ten", 10, True)]


def test_word_documents_keep_tables_lists_and_headings_of_any_style():
    style = lambda n: f'<w:pPr><w:pStyle w:val="{n}"/></w:pPr>'
    p = lambda text, pr="": f"<w:p>{pr}<w:r><w:t>{text}</w:t></w:r></w:p>"
    item = lambda depth: f'<w:pPr><w:numPr><w:ilvl w:val="{depth}"/><w:numId w:val="4"/></w:numPr></w:pPr>'
    cell = lambda *inner: f"<w:tc><w:tcPr/>{''.join(inner)}</w:tc>"
    nested = f"<w:tbl><w:tr>{cell(p('x'))}{cell(p('y'))}</w:tr></w:tbl>"
    body = [
        p("Boats", style("Kop1")), p("Old", style("Kop2")), p("first", item(0)), p("inner", item(1)), p("none", '<w:pPr><w:numPr><w:numId w:val="0"/></w:numPr></w:pPr>'),
        f"<w:tbl><w:tr>{cell(p('Name'))}{cell(p('Built'), p('in'))}</w:tr><w:tr>{cell(p('Ria'))}{cell(nested)}</w:tr><w:tr>{cell('<w:p/>')}{cell()}</w:tr></w:tbl>",
        p("Sums", '<w:pPr><w:tabs><w:tab w:val="left"/></w:tabs><w:outlineLvl w:val="0"/></w:pPr>'),
        "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c &amp; d</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:moveFrom><w:r><w:t>away</w:t></w:r></w:moveFrom></w:p>",
        f"<w:p><mc:AlternateContent><mc:Choice><w:txbxContent>{p('boxed')}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{p('boxed')}</w:txbxContent></mc:Fallback></mc:AlternateContent><w:r><w:t>around</w:t></w:r></w:p>",
    ]
    styles = '<w:styles><w:style w:styleId="Kop1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Kop2"><w:name w:val="Kop"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style></w:styles>'
    whole = archive(word__document=f'<?xml version="1.0"?><w:document><w:body>{"".join(body)}</w:body></w:document>', word__styles=styles, docProps__core="<cp:coreProperties><dc:title>The &lt;fleet&gt;</dc:title><dc:creator>n</dc:creator></cp:coreProperties>")
    got = documents.docx(whole)
    old = ["Boats", "Old"]
    assert got == [Block("- first", old), Block("  - inner", old), Block("none", old), Block("Name | Built in\nRia | x | y", old, kind="table"), Block("a\tb\nc & d", ["Sums"]), Block("boxed", ["Sums"]), Block("around", ["Sums"])]
    assert documents.title(whole, documents.EXTENSIONS["docx"], got) == "The <fleet>"
    plain = archive(word__document=p("Only", style("Heading3")) + p("text"))
    assert documents.title(plain, documents.EXTENSIONS["docx"], documents.docx(plain)) == "Only"
    for reader in (documents.docx, documents.pptx):
        with pytest.raises(ValueError):
            reader(archive(other="<x/>"))


def slide(*shapes):
    made = "".join(f'<p:sp><p:nvPr><p:ph type="{kind}"/></p:nvPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)}</p:txBody></p:sp>' for kind, *texts in shapes)
    return f"<p:sld><p:spTree>{made}</p:spTree></p:sld>"


def test_slides_have_their_titles_tables_and_own_notes():
    link = lambda k: f'<Relationships><Relationship Id="rId1" Type="http://x/slideLayout" Target="../slideLayouts/slideLayout1.xml"/><Relationship Id="rId2" Type="http://x/notesSlide" Target="../notesSlides/notesSlide{k}.xml"/></Relationships>'
    cells = "<a:tbl><a:tr><a:tc><a:p><a:r><a:t>Q1</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>7</a:t></a:r></a:p></a:tc></a:tr></a:tbl>"
    parts = {
        "ppt__slides__slide1": slide(("title", "Plan"), ("body", "one", "two"), ("sldNum", "1"), ("body", "aside")),
        "ppt__slides__slide2": slide(("ctrTitle", "Figures", "of the year")).replace("</p:spTree>", f"<p:graphicFrame>{cells}</p:graphicFrame></p:spTree>"),
        "ppt__slides__slide3": slide(("title", "Thanks")),
        "ppt__slides__slide4": slide(("body", "")),
        "ppt__slides__slide5": slide(("body", "last")),
        "ppt__notesSlides__notesSlide1": slide(("sldImg",), ("body", "say the figures"), ("sldNum", "2")),
        "ppt__notesSlides__notesSlide5": slide(("body", "by number")),
    }
    deck = io.BytesIO(archive(**parts))
    with zipfile.ZipFile(deck, "a") as z:
        z.writestr("ppt/slides/_rels/slide2.xml.rels", link(1))
        for k in (1, 3):
            z.writestr(f"ppt/slides/_rels/slide{k}.xml.rels", "<Relationships/>")
    got = documents.pptx(deck.getvalue())
    assert [(b.text, b.headings, b.page) for b in got] == [
        ("one\ntwo\n\naside", ["Plan"], 1),
        ("Q1 | 7\n\nSpeaker notes: say the figures", ["Figures of the year"], 2),
        ("Thanks", [], 3),
        ("last\n\nSpeaker notes: by number", [], 5),
    ]
    made = chunk.chunks(got, chunk.PLANS[documents.EXTENSIONS["pptx"]])
    assert [c["text"].split("\n")[0] for c in made] == ["Plan", "Figures of the year", "Thanks", "last"]


def test_code_is_cut_at_functions():
    got = documents.python_code("import a\n\nclass C:\n    x = 1\n    def m(self):\n        return 1\n\ndef f():\n    pass\nprint(1)\n")
    assert [b.headings for b in got] == [["preamble"], ["C", "m"], ["f"], ["epilogue"]]


def test_chunks_are_packed_with_overlap():
    plan = chunk.Plan(tokens=64, overlap=8)
    got = chunk.chunks([Block("word " * 30), Block("next " * 30), Block("long " * 120)], plan)
    assert [c["ordinal"] for c in got] == list(range(len(got))) and all(len(c["text"]) <= 64 * 4 + 8 * 4 + 4 for c in got)
    assert got[1]["text"].startswith("word word")
    with pytest.raises(ValueError):
        chunk.Plan(tokens=10)


def test_overlap_stays_within_a_group():
    got = chunk.chunks([Block("a" * 100, ["H1"]), Block("b" * 100, ["H2"])], chunk.PLANS["text/markdown"])
    assert [c["text"] for c in got] == ["H1\n\n" + "a" * 100, "H2\n\n" + "b" * 100]


def test_chunked_rows_and_neighbours(spark):
    df = spark.createDataFrame([(1, "p one\n\n" + "x " * 3000), (2, None)], "doc long, text string")
    from pyspark.sql import functions as F

    got = chunk.chunked(df, "text", F.lit("text/plain"))
    assert got.where("doc = 2").count() == 0 and got.count() > 2
    near = chunk.with_neighbours(got.where("ordinal = 1"), got, "doc")
    assert sorted(r.ordinal for r in near.collect()) == [0, 1, 2]


def test_a_stream_fills_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"n": k, "kind": "a"}) + "\n")
    store = Store(spark, str(tmp_path / "store"))
    fields = [Field(ColumnSpec("n", "BIGINT"), "$.n"), Field(ColumnSpec("kind", "VARCHAR"), "$.kind")]
    for _ in range(2):
        ingest.ingest(store, "t", ingest.json_lines(spark, str(tmp_path / "in")), fields, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.n for r in store.view("t").collect()) == [0, 1, 2]
    store.roll_up("t")
    assert store.view("t").count() == 3
    # the commit of the last micro-batch is lost, so it runs again
    for name in ("0", ".0.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    ingest.ingest(store, "t", ingest.json_lines(spark, str(tmp_path / "in")), fields, str(tmp_path / "check")).awaitTermination(120)
    assert store.view("t").count() == 3


def test_files_become_rows_and_chunks(spark, tmp_path):
    from tablewell.operators import ingest_files, two_tier

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Title\n\none\n\n## Part\n\ntwo")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.7 x")
    store = Store(spark, str(tmp_path / "store"))
    ingest_files.add_files(store, spark.read.format("binaryFile").load(str(tmp_path / "in")))
    got = {r.filename: r for r in store.view("well_files").collect()}
    assert (got["a.md"].status, got["a.md"].chunk_count, got["a.md"].title) == ("ready", 2, "Title") and got["b.pdf"].status == "failed"
    assert sorted(r.text for r in store.view("well_file_chunks").collect()) == ["Title\n\none", "Title > Part\n\ntwo"]
    assert store.embed("well_file_chunks") == 2 and store.embed("well_file_chunks") == 0
    batches = spark.createDataFrame([("b1", '{"service": "checkout", "count": 12, "count2": "checkout"}', 3)], "source_batch string, body string, row_count int")
    ingest_files.add_receipts(store, "incidents", batches)
    assert store.view("well_receipts").first().search_term == "incidents count count2 service checkout"
    snap = store.snapshot("well_files")
    assert two_tier.view(snap["manifest"], snap["base"], snap["fresh"], snap["tombstones"]).count() == 2

"""A query over office documents that Spark makes of the order lines: a Word document and a slide deck for each order."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest_files import chunks_of_files
from ..session import table

ORDERS = 500  # whose files are made before they are passed on
# Of a zip archive, what entries hold in both places, the rest of an entry in the directory, the directory's end.
ENTRY, REST, END = struct.Struct("<5H3L2H"), struct.Struct("<3H2L"), struct.Struct("<4H2LH")


def _archive(parts: dict[str, str]) -> bytes:
    """A zip archive of parts as they are, the bytes that zipfile writes for entries without a date."""
    out, directory, at = [], [], 0
    for name, xml in parts.items():
        raw, data = name.encode(), xml.encode()
        entry = ENTRY.pack(20, 0, 0, 0, 33, zlib.crc32(data), len(data), len(data), len(raw), 0)
        out += (b"PK\3\4", entry, raw, data)
        directory += (b"PK\1\2\x14\3", entry, REST.pack(0, 0, 0, 0o600 << 16, at), raw)
        at += 30 + len(raw) + len(data)
    size = sum(map(len, directory))
    return b"".join((*out, *directory, b"PK\5\6", END.pack(0, 0, len(parts), len(parts), size, at, 0)))


def _document(order: int, lines: list[tuple]) -> bytes:
    """A heading, and a table of the lines (number, quantity, flag) below it."""
    row = lambda *cells: f"<w:tr>{''.join([f'<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>' for c in cells])}</w:tr>"
    heading = f'<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Order {order}</w:t></w:r></w:p>'
    rows = "".join([row(*x) for x in lines])
    styles = '<w:styles><w:style w:styleId="H"><w:name w:val="heading 1"/></w:style></w:styles>'
    return _archive({"word/document.xml": f"<w:document><w:body>{heading}<w:tbl>{row('Line', 'Quantity', 'Flag')}{rows}</w:tbl></w:body></w:document>", "word/styles.xml": styles})


def _deck(lines: list[tuple]) -> bytes:
    """A slide for each line; the notes are numbered from the last slide to the first, so only relationships tell whose they are."""
    shape = lambda kind, text: f'<p:sp><p:ph type="{kind}"/><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    parts = {}
    for k, (n, quantity, flag) in enumerate(lines, 1):
        other = len(lines) + 1 - k
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld>{shape('title', f'Line {n}')}{shape('body', f'Quantity {quantity}')}{shape('sldNum', k)}</p:sld>"
        parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = f'<Relationships><Relationship Id="r1" Type="http://x/notesSlide" Target="../notesSlides/notesSlide{other}.xml"/></Relationships>'
        parts[f"ppt/notesSlides/notesSlide{other}.xml"] = f"<p:notes>{shape('body', f'flag {flag}')}</p:notes>"
    return _archive(parts)


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ORDERS):
            own, made = batch[at : at + ORDERS], []
            for order, *columns in zip(own["l_orderkey"], own["n"], own["quantity"], own["flag"], strict=True):
                lines = list(zip(*columns, strict=True))
                made += [(f"orders/{order}.docx", _document(order, lines)), (f"orders/{order}.pptx", _deck(lines))]
            yield pd.DataFrame([(path, len(content), content) for path, content in made], columns=["path", "length", "content"])


def office_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of both files of each order; one file holds the lines of one order."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_returnflag").alias("flag"))
    # a number of its own, so that few bytes of lines, which are much work, aren't brought together in one task
    dealt = table(spark, sf_dir, "lineitem").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    lines = dealt.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    columns = [F.col(f"lines.{c}").cast("array<string>").alias(c) for c in ("n", "quantity", "flag")]  # lists of text become pandas' without structs of Python
    return chunks_of_files(lines.select("l_orderkey", *columns).mapInPandas(_files, "path string, length long, content binary"))


OFFICE_CHUNKS = """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, q, f) AS page FROM l)
SELECT o || '.docx' AS filename, 'Order ' || o AS title, 'ready' AS status, CAST(0 AS INTEGER) AS ordinal, CAST(NULL AS INTEGER) AS page,
 'Order ' || o || chr(10) || chr(10) || 'Line | Quantity | Flag' || chr(10) || string_agg(n || ' | ' || q || ' | ' || f, chr(10) ORDER BY n, q, f) AS text FROM l GROUP BY o
UNION ALL SELECT o || '.pptx', 'Line ' || first_value(n) OVER (PARTITION BY o ORDER BY page), 'ready', CAST(page - 1 AS INTEGER), CAST(page AS INTEGER), 'Line ' || n || chr(10) || chr(10) || 'Quantity ' || q || chr(10) || chr(10) || 'Speaker notes: flag ' || f FROM k"""

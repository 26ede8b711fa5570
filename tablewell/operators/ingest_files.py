"""Files to the system tables of files and chunks, and receipts to theirs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.search import rarest_words
from ..manifest import ColumnSpec, FullText
from ..sources import documents
from ..store import Store
from . import chunk

FILES, CHUNKS, RECEIPTS = "well_files", "well_file_chunks", "well_receipts"
# Columns of the system tables.
FILE_COLUMNS = [
    ColumnSpec("file_id", "VARCHAR"), ColumnSpec("external_id", "VARCHAR"), ColumnSpec("filename", "VARCHAR"), ColumnSpec("media_type", "VARCHAR"), ColumnSpec("bytes", "BIGINT"),
    ColumnSpec("sha256", "VARCHAR"), ColumnSpec("status", "VARCHAR"), ColumnSpec("pages", "INTEGER"), ColumnSpec("chunk_count", "INTEGER"), ColumnSpec("error", "VARCHAR"),
    ColumnSpec("title", "VARCHAR", embedded=True), ColumnSpec("summary", "VARCHAR", embedded=True),
]
CHUNK_COLUMNS = [
    ColumnSpec("file_id", "VARCHAR"), ColumnSpec("ordinal", "INTEGER"), ColumnSpec("text", "VARCHAR", embedded=True), ColumnSpec("kind", "VARCHAR"), ColumnSpec("tokens", "INTEGER"),
    ColumnSpec("page", "INTEGER"), ColumnSpec("section", "VARCHAR"), ColumnSpec("ocr", "BOOLEAN"),
]
RECEIPT_COLUMNS = [
    ColumnSpec("source_batch", "VARCHAR"), ColumnSpec("external_id", "VARCHAR"), ColumnSpec("source_table", "VARCHAR"), ColumnSpec("summary", "VARCHAR", embedded=True),
    ColumnSpec("search_term", "VARCHAR", embedded=True), ColumnSpec("body", "VARCHAR", embedded=True), ColumnSpec("row_count", "INTEGER"), ColumnSpec("model", "VARCHAR"),
]
CHUNK_SEARCH = FullText(True, ignore="[^a-z0-9]+", columns=("text",))
MOST_BODY = 8000
_READ = T.StructType([T.StructField(n, T.StringType()) for n in ("media_type", "status", "error", "title")] + [T.StructField("pages", T.IntegerType()), T.StructField("chunks", T.ArrayType(chunk.CHUNK))])
_ARROW = to_arrow_schema(_READ)


def _read(names: pa.Array, contents: pa.Array) -> pa.Array:
    rows = []
    for name, content in zip(names.to_pylist(), contents, strict=True):
        raw = content.as_py() or b""
        try:
            kind = documents.media_type(name, raw)
            own = documents.opened(raw, kind)
            blocks = documents.blocks(own, kind)
            rows.append((kind, "ready", None, documents.title(own, kind, blocks), max((b.page or 0 for b in blocks), default=0) or None, chunk.chunks(blocks, chunk.PLANS.get(kind, chunk.Plan()))))
        except Exception as e:  # a file that can't be read is a row that says so
            rows.append((None, "failed", str(e)[:500], None, None, []))
    columns = list(zip(*rows, strict=True)) or [()] * len(_READ)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], fields=list(_ARROW))


def _opened(files: DataFrame) -> DataFrame:
    """Each file with what was read from it, under `r`."""
    read = F.arrow_udf(_read, _READ).asNondeterministic()  # else Spark reads each file again, to filter by its number of chunks
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.sha2(F.concat(F.col("path").cast("binary"), "content"), 256).alias("file_id"), F.col("path").alias("external_id"), name.alias("filename"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), read(name, F.col("content")).alias("r"),
    )


def chunks_of_files(files: DataFrame) -> DataFrame:
    """The chunks of files, each beside filename, title and status of its own file: every file is read once, and nothing is joined."""
    read = _opened(files).select("filename", F.col("r.title").alias("title"), F.col("r.status").alias("status"), F.explode("r.chunks").alias("c"))
    return read.select("filename", "title", "status", "c.ordinal", "c.page", "c.text")


def files_and_chunks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the two system tables from files as Spark's binaryFile source reads them (path, length, content)."""
    read = _opened(files)
    table = read.select(
        "file_id", "external_id", "filename", "r.media_type", "bytes", "sha256", "r.status", "r.pages", F.size("r.chunks").alias("chunk_count"), "r.error", "r.title",
        F.substring(F.try_element_at("r.chunks", F.lit(1))["text"], 1, 400).alias("summary"),
    )
    parts = read.select("file_id", F.explode("r.chunks").alias("c")).select("file_id", "c.ordinal", "c.text", "c.kind", "c.tokens", "c.page", "c.section", F.lit(False).alias("ocr"))
    return table, parts


def add_files(store: Store, files: DataFrame) -> dict:
    """Append files and their chunks; a file that fails gets a row with its error."""
    table, parts = files_and_chunks(files)
    done = {t: store.add_rows(t, rows, columns, key, system=True) for t, rows, columns, key in ((FILES, table, FILE_COLUMNS, ["file_id"]), (CHUNKS, parts, CHUNK_COLUMNS, ["file_id", "ordinal"]))}
    store.configure(CHUNKS, CHUNK_SEARCH)
    return done


def add_receipts(store: Store, table: str, batches: DataFrame) -> dict:
    """Append a receipt for each batch (source_batch, body, row_count): its search term is the table's name and the body's
    rarest words; its body is clamped."""
    terms = rarest_words(batches, "source_batch", "body").select("source_batch", F.concat_ws(" ", F.lit(table), F.array_join("words", " ")).alias("search_term"))
    rows = batches.join(terms, "source_batch", "left").select(
        "source_batch", F.lit(None).cast("string").alias("external_id"), F.lit(table).alias("source_table"), F.concat(F.col("row_count").cast("string"), F.lit(f" rows in {table}")).alias("summary"),
        F.coalesce("search_term", F.lit(table)).alias("search_term"), F.substring("body", 1, MOST_BODY).alias("body"), F.col("row_count").cast("int").alias("row_count"), F.lit("extractive").alias("model"),
    )
    return store.add_rows(RECEIPTS, rows, RECEIPT_COLUMNS, ["source_batch"], system=True)

"""Typed rows from many delimited files whose headers differ, by a declared mapping.

Each file is read by its own header and separator. A file that can't be read is a row of errors, not a failed job: no header,
too many fields, quotes that don't close, a record with more fields than the header. One aggregation over (file, column)
finds each file's narrowest types; those of a column are joined over all files in the order boolean; integer, bigint, double;
text, where text is above all and a boolean and a number meet in text only. A column whose type is declared keeps it, and
a file with a value that doesn't fit is a row of errors too, which names the column and the value.

Columns that a file lacks are null in its rows. Headings are compared as identifiers. Empty cells are null; a number with a
leading zero is text. A column that no file fills is text. Without declared columns all headings are taken, at most
`MOST_FIELDS`. Files are (path, content); a null content is a file without a header. Repeated paths are one file each time.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import from_heading, identifier
from ..session import fixed
from ..sources.delimited import _INT, _NUM, MOST_FIELDS, SAFE, separator_of
from ..types import _ISO, spark_type

NULL, BOOLEAN, INTEGER, BIGINT, DOUBLE, TEXT = range(6)
KINDS = ("string", "boolean", "int", "bigint", "double", "string")
RECORDS = "file long, path string, row long, names array<string>, cells array<string>, error string"
CELL_CHARS = 60


@dataclass(frozen=True)
class Wanted:
    """How a column is filled: by a heading or a constant; its type, or None to have it inferred."""

    name: str
    heading: str | None = None
    value: str | None = None
    type: str | None = None

    def checked(self) -> Wanted:
        if (self.heading is None) == (self.value is None):
            raise ValueError(f"column {self.name} needs a heading or a value, and not both")
        if self.type is not None:
            spark_type(self.type)
        heading = None if self.heading is None else from_heading(self.heading, 1, set())
        return Wanted(identifier(self.name), heading, self.value, self.type)


def _parsed(content: str | None) -> Iterator[tuple[list[str], list[str]] | str]:
    """The names and cells of each record, or what is wrong with the file."""
    lines = (content or "").removeprefix("﻿").lstrip("\r\n").splitlines(keepends=True)
    if not lines or not lines[0].strip():
        yield "a delimited file needs a header"
        return
    taken: set[str] = set()
    names: list[str] | None = None
    try:
        for record in csv.reader(iter(lines), delimiter=separator_of(lines[0]), strict=True):
            if names is None:
                if len(record) > MOST_FIELDS:
                    yield f"more than {MOST_FIELDS} fields"
                    return
                names = [from_heading(h, k, taken) for k, h in enumerate(record, 1)]
            elif len(record) > len(names) and any(record[len(names) :]):
                yield f"a record has {len(record)} fields, the header {len(names)}"
                return
            elif any(c.strip() for c in record):
                yield names, record[: len(names)]
    except csv.Error as e:
        yield f"the file can't be read: {e}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    labels = ["file", "path", "row", "names", "cells", "error"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=labels)

    for batch in batches:
        for file, path, content in zip(*(batch.column(k) for k in range(3)), strict=True):
            rows: list[tuple] = []
            head = file.as_py(), path.as_py()
            for k, record in enumerate(_parsed(content.as_py())):
                rows.append((*head, k, None, None, record) if isinstance(record, str) else (*head, k, *record, None))
                if len(rows) == 5000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)


def _kind(v: Column) -> Column:
    """The narrowest type of a cell, as its place in the lattice."""
    wide = v.try_cast("decimal(38,0)")
    whole = F.when(wide.between(F.lit(-(2**31)), F.lit(2**31 - 1)), INTEGER).when(wide.between(F.lit(-SAFE), F.lit(SAFE)), BIGINT).otherwise(TEXT)
    return F.when(v.isNull(), NULL).when(v.isin("true", "false"), BOOLEAN).when(v.rlike(_INT), whole).when(v.rlike(_NUM), DOUBLE).otherwise(TEXT)


def _joined(kind: str) -> Column:
    """The least type that holds all of these; a boolean and a number are both text."""
    mixed = F.max(F.col(kind) == BOOLEAN) & F.max(F.col(kind).between(INTEGER, DOUBLE))
    return F.when(mixed, TEXT).otherwise(F.max(kind))


def _fits(v: Column, kind: str) -> Column:
    if kind in ("VARCHAR", "JSON"):
        return F.lit(True)
    shape = {"INTEGER": v.rlike(_INT), "BIGINT": v.rlike(_INT), "DOUBLE": v.rlike(_NUM), "BOOLEAN": v.isin("true", "false")}.get(kind, v.rlike(_ISO))
    return shape & v.try_cast(spark_type(kind)).isNotNull()


def column_types(records: DataFrame, wanted: list[Wanted] | None) -> dict[str, str]:
    """The Spark type of each heading that isn't declared, joined over the files."""
    cells = records.where("error IS NULL").select("file", F.explode(F.arrays_zip("names", "cells")).alias("c")).select("file", F.col("c.names").alias("name"), F.trim("c.cells").alias("v"))
    if wanted is not None:
        cells = cells.where(F.col("name").isin(*{w.heading for w in wanted if w.heading}))
    per_file = cells.withColumn("kind", _kind(F.when(F.col("v") != "", F.col("v")))).groupBy("file", "name").agg(_joined("kind").alias("kind"))
    found = per_file.groupBy("name").agg(_joined("kind").alias("kind")).orderBy("name").limit(MOST_FIELDS + 1).collect()
    if len(found) > MOST_FIELDS:
        raise ValueError(f"the files have more than {MOST_FIELDS} headings; declare the columns")
    return {r.name: KINDS[r.kind] for r in found}


def extracted(files: DataFrame, columns: list[Wanted] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (path, row, and the columns) of the files (path, content) that fit, and (path, error) of the others."""
    wanted = None if columns is None else [c.checked() for c in columns]
    if wanted is not None and len({w.name for w in wanted}) < len(wanted):
        raise ValueError("two columns have the same name")
    numbered = files.select(F.monotonically_increasing_id().alias("file"), "path", "content")
    records = fixed(numbered.mapInArrow(_read, RECORDS))
    kinds = column_types(records, wanted)
    own = wanted if wanted is not None else [Wanted(n, n) for n in kinds]
    cell = lambda heading: F.get("cells", F.nullif(F.array_position("names", F.lit(heading)), F.lit(0)).cast("int") - 1)
    text = {w.name: F.lit(w.value) if w.value is not None else F.when(F.trim(cell(w.heading)) != "", cell(w.heading)) for w in own}
    unfit = [F.when(text[w.name].isNotNull() & ~F.coalesce(_fits(F.trim(text[w.name]), w.type), F.lit(False)), F.concat(F.lit(f"column {w.name}: "), F.substring(text[w.name], 1, CELL_CHARS), F.lit(f" is no {w.type}"))) for w in own if w.type]
    checked = records.withColumn("error", F.coalesce("error", *unfit))
    errors = checked.where("error IS NOT NULL").groupBy("file", "path").agg(F.min_by("error", "row").alias("error"))
    good = records.join(errors.select("file"), "file", "left_anti")
    kind_of = lambda w: spark_type(w.type) if w.type else kinds.get(w.heading, "string")
    typed = {w.name: (text[w.name] if kind_of(w) == "string" else F.trim(text[w.name])).try_cast(kind_of(w)) for w in own}
    return good.select(F.col("path").alias("_path"), F.col("row").alias("_row"), *(c.alias(n) for n, c in typed.items())), errors.select(F.col("path").alias("_path"), "error")

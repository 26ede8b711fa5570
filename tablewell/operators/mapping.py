"""JSON documents to rows by a declared mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import paths
from ..manifest import ColumnSpec
from ..names import RAW
from ..types import coerced, spark_type

MOST_ROWS = 10_000


@dataclass(frozen=True)
class Field:
    """A column, and where its value comes from: a path, or the same constant for every row."""

    spec: ColumnSpec
    path: str | None = None
    value: str | None = None

    def __post_init__(self) -> None:
        if (self.path is None) == (self.value is None):
            raise ValueError(f"column {self.spec.name} needs either a path or a value")


def rows_of(documents: DataFrame, column: str, fields: list[Field], rows: str | None = None, raw: bool = False, most_rows: int | None = MOST_ROWS) -> DataFrame:
    """A row for each element that the `rows` path finds in each document, or for each document.

    `column` holds JSON text; other columns of `documents` pass. Every path is read before anything runs. With `most_rows`
    a document of more elements is refused as a whole.
    """
    read = [paths.parse(f.path) if f.path is not None else None for f in fields]
    at = paths.parse_rows(rows)
    passed = [c for c in documents.columns if c != column]
    parsed = documents.select(*passed, F.parse_json(column).alias("document__"))
    # what is read from the whole document is read once, and only that goes on to its rows
    above = {f"above__{k}": p.read(F.col("document__"), F.col("document__")) for k, p in enumerate(read) if p is not None and p.whole}
    parsed = parsed.withColumns(above)
    if at is None:
        elements = parsed.withColumnRenamed("document__", "element__")
    else:
        found = at.read(F.col("document__"), F.col("document__"))
        items = F.try_variant_get(found, "$", "array<variant>")
        if most_rows is not None:
            items = F.when(F.size(items) > most_rows, F.raise_error(F.concat(F.lit(f"a document may hold {most_rows} rows, this one holds "), F.size(items)))).otherwise(items)
        elements = parsed.select(*passed, *above, F.explode(items).alias("element__"))

    def made(k: int, f: Field, path: paths.Path | None) -> Column:
        value = F.lit(f.value).cast("variant") if path is None else F.col(f"above__{k}") if path.whole else path.read(F.col("element__"), F.col("element__"))
        out = coerced(value, f.spec.type, f.spec.name)
        if f.spec.required:
            out = F.when(out.isNull(), F.raise_error(F.lit(f"column {f.spec.name} is required")).cast(spark_type(f.spec.type))).otherwise(out)
        return out.alias(f.spec.name)

    extra = [F.to_json("element__").alias(RAW)] if raw else []
    return elements.select(*passed, *(made(k, f, p) for k, (f, p) in enumerate(zip(fields, read, strict=True))), *extra)


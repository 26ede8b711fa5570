"""Delimited files: the separator is found, types are inferred by strict rules."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import from_heading

SEPARATORS = (",", "\t", ";", "|")
MOST_FIELDS = 512
_INT = r"^(0|-?[1-9][0-9]*)$"
_NUM = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
SAFE = 2**53 - 1


def separator_of(header: str) -> str:
    """The separator that the header line holds most often; the first of equals, a comma if there is none."""
    return max(SEPARATORS, key=lambda s: (header.count(s), -SEPARATORS.index(s))) if any(s in header for s in SEPARATORS) else ","


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header."""
    header = spark.read.text(path).where("trim(value) <> ''").limit(1).first()
    if header is None:
        raise ValueError("a delimited file needs a header")
    sep = separator_of(header.value)
    names = next(csv.reader([header.value], delimiter=sep))
    if len(names) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    kinds = ", ".join(f"f{k} string" for k in range(len(names)))
    rows = spark.read.csv(path, schema=kinds, header=True, enforceSchema=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE")
    return rows.toDF(*names)


def inferred(rows: DataFrame) -> DataFrame:
    """Names made identifiers and every column cast to the narrowest type that holds all its values.

    One aggregation looks at all columns. Empty text is NULL. A number with a leading zero keeps its column text.
    """
    taken: set[str] = set()
    names = [from_heading(c, k, taken) for k, c in enumerate(rows.columns, 1)]
    named = rows.toDF(*(f"f{k}" for k in range(len(names))))
    value = lambda k: F.when(F.trim(f"f{k}") != "", F.trim(f"f{k}"))
    checks: list[Column] = []
    for k in range(len(names)):
        v = value(k)
        wide = F.when(v.rlike(_INT), v.try_cast("decimal(38,0)"))
        checks += [
            F.count(v).alias(f"n{k}"), F.every(v.rlike(_INT)).alias(f"int{k}"), F.every(v.rlike(_NUM)).alias(f"num{k}"),
            F.every(v.isin("true", "false")).alias(f"bool{k}"), F.min(wide).alias(f"lo{k}"), F.max(wide).alias(f"hi{k}"),
            F.count(F.when(v.rlike(_INT) & wide.isNull(), 1)).alias(f"far{k}"),
        ]
    seen = named.agg(*checks).first()

    def kind(k: int) -> str:
        if not seen[f"n{k}"]:
            return "string"
        if seen[f"int{k}"]:
            lo, hi = seen[f"lo{k}"], seen[f"hi{k}"]
            if seen[f"far{k}"] or lo is None or max(-lo, hi) > SAFE:
                return "string"
            return "int" if -(2**31) <= lo and hi < 2**31 else "bigint"
        return "double" if seen[f"num{k}"] else "boolean" if seen[f"bool{k}"] else "string"

    return named.select(*((value(k) if kind(k) != "string" else F.when(F.trim(f"f{k}") != "", F.col(f"f{k}"))).cast(kind(k)).alias(n) for k, n in enumerate(names)))

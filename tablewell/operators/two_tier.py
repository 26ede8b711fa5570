"""The two-tier view: base rows and pending rows, less tombstones, with vectors; all of it lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..manifest import Manifest
from ..names import RAW, ROW_ID, SYSTEM, VECTOR_SUFFIX
from ..types import spark_type

SYSTEM_TYPES = {"_row_id": "string", "_ingested_at": "timestamp_ntz", "_batch": "string"}


def declared(manifest: Manifest) -> list[tuple[str, str]]:
    """Names and Spark types of a table's columns, system columns last."""
    own = [(c.name, spark_type(c.type)) for c in manifest.columns]
    return [*own, *((s, SYSTEM_TYPES[s]) for s in SYSTEM), *([(RAW, "string")] if manifest.raw else [])]


def conformed(df: DataFrame, manifest: Manifest) -> DataFrame:
    """The frame's columns cast to the declared types; NULL where it has none."""
    have = set(df.columns)
    return df.select(*(F.col(name).cast(kind).alias(name) if name in have else F.lit(None).cast(kind).alias(name) for name, kind in declared(manifest)))


def without(df: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    """Rows that no tombstone names. Row ids are never null, so an anti-join is the same as NOT IN."""
    return df if tombstones is None else df.join(tombstones.select(ROW_ID), ROW_ID, "left_anti")


def pivoted(vectors: DataFrame, columns: list[str]) -> DataFrame:
    """Vectors in rows (row, column, vector) as a column each."""
    wide = vectors.groupBy(ROW_ID).pivot("column", columns).agg(F.first("vector"))
    return wide.select(ROW_ID, *(F.col(c).alias(c + VECTOR_SUFFIX) for c in columns))


def unpivoted(wide: DataFrame, columns: list[str]) -> DataFrame:
    """The other way round, rows without a vector left out."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c + VECTOR_SUFFIX).alias("vector")) for c in columns)))
    return wide.select(ROW_ID, each.alias("v")).select(ROW_ID, "v.column", "v.vector").where("vector IS NOT NULL")


def preferred_vectors(fresh: DataFrame | None, base: DataFrame | None, columns: list[str], dims: int) -> DataFrame | None:
    """One row per row id with a vector column each: the fresh one if there is one, else the base's; a vector of another
    width than the table's is none."""
    sides = []
    for rank, side in enumerate((fresh, base)):
        if side is not None:
            sides.append(side.where(F.size("vector") == dims).select(ROW_ID, "column", "vector", F.lit(rank).alias("rank")))
    if not sides:
        return None
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    best = both.groupBy(ROW_ID, "column").agg(F.min_by("vector", "rank").alias("vector"))
    return pivoted(best, columns)


def view(manifest: Manifest, base: DataFrame | None, fresh: DataFrame | None, tombstones: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The table: base rows that lack a column get NULL, tombstones hide rows of both tiers, vectors are attached."""
    tiers = [conformed(t, manifest) for t in (base, fresh) if t is not None]
    if not tiers:
        raise ValueError(f"table {manifest.name} has neither a base nor pending rows")
    rows = tiers[0] if len(tiers) == 1 else tiers[0].unionByName(tiers[1])
    live = without(rows, tombstones)
    return live if vectors is None else live.join(vectors, ROW_ID, "left")

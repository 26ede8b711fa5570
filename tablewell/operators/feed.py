"""Receipts of writes, and coalesced change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.search import rarest_words
from ..manifest import Manifest
from ..names import BATCH, ROW_ID

MOST_ITEMS = 100


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


def receipt(manifest: Manifest, batch: str, items: list[dict]) -> dict:
    """Statements that find a write again: the batch, and each of its first items by key or row id."""
    key = manifest.key or (ROW_ID,)
    where = lambda row: " AND ".join(f"{k} IS NULL" if row.get(k) is None else f"{k} = {_literal(row[k])}" for k in key)
    return {
        "batch": f"SELECT * FROM {manifest.name} WHERE {BATCH} = {_literal(batch)}",
        "items": [f"SELECT * FROM {manifest.name} WHERE {where(r)}" for r in items[:MOST_ITEMS]],
        "table": {"name": manifest.name, "rows": manifest.rows, "columns": {c.name: c.type for c in manifest.columns}},
    }


def summaries(rows: DataFrame, table: str, row_id: str, text: str) -> DataFrame:
    """(row id, search_term): the table's name and the rarest words of a row's text."""
    return rarest_words(rows, row_id, text).select(row_id, F.concat_ws(" ", F.lit(table), F.array_join("words", " ")).alias("search_term"))


def coalesced(events: DataFrame) -> DataFrame:
    """One event for each event kind and table: rows and tombstones summed, the last seq, the first replaced generation."""
    return events.groupBy("event", "table").agg(
        F.sum("rows").alias("rows"), F.sum("tombstones").alias("tombstones"), F.max("seq").alias("seq"), F.min("previous_generation").alias("previous_generation")
    )

"""Continuous ingest into a table, roll-ups, the outbox, and event-time windows, as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feed import coalesced
from ..operators.mapping import Field
from ..store import Store


def ingest(store: Store, table: str, source: DataFrame, fields: list[Field], checkpoint: str, rows: str | None = None, column: str = "json") -> StreamingQuery:
    """Append the JSON documents of a streaming source to a table, and fold when it's due; ends when the source is read.

    The table keeps the number of the last micro-batch of each source (known by its checkpoint folder), so one that is
    replayed after a failure isn't appended twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.add(table, batch, fields, rows, column=column, source=(checkpoint, number))
        if store.due(table):
            store.roll_up(table)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outbox(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the coalesced events of each micro-batch to a folder; a repeated micro-batch replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        coalesced(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and kind; rows later than `late` are dropped when it streams."""
    seen = events.withColumn("at", F.col("ts").cast("timestamp"))
    seen = seen.withWatermark("at", late) if events.isStreaming else seen
    window = F.window("at", length, slide or length)
    return seen.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files of one JSON document per line, as a stream."""
    return spark.readStream.text(path).withColumnRenamed("value", "json")

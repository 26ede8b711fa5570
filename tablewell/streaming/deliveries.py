"""Change events folded across micro-batches: what waits for its delivery takes in what follows.

The first event of a (event, table) waits `wait`; all that come before it is delivered are folded into it. A delivery is made
once the watermark has passed it, so its time and content depend on the events' times alone: a stream that is cut into
other micro-batches, or stopped and started again, makes the same deliveries. Each task folds its events by time before they
are shuffled, so a table that a third of all events are about sends a row for each of its times and task.

What waits is held by slots of time as long as `wait`, each slot's events as one value of numbers folded by time, and slots are
read one at a time; so a task's memory is that of one slot and one block of rows, whatever a table's events.

Needs RocksDB as state store (`spark.sql.streaming.stateStore.providerClass`), as Spark's stateful operators with timers do;
state is kept in the query's checkpoint folder. Odd cases: nulls in figures count as missing, in event or table as a value
of their own; events without a time are folded as of the epoch, so they are delivered at once, and are late once a watermark
exists; events later than `late` are dropped, as by every watermark. At the end of a stream the last deliveries still wait.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# How each figure of two events is folded into one.
FOLDS = {"rows": "sum", "tombstones": "sum", "seq": "max", "previous_generation": "min"}
# What a missing figure is folded as; a bit of `known` for each figure says that one was there.
_NEUTRAL = {"sum": 0, "max": -(2**63), "min": 2**63 - 1}
_ADD = {"sum": np.add, "max": np.maximum, "min": np.minimum}
_COLUMNS = ("at_ms", *FOLDS, "known")
BLOCK_ROWS = 1 << 18
_KEYED = "`event` string, `table` string"
OUT = f"{_KEYED}, first_ms long, {', '.join(f'`{n}` long' for n in FOLDS)}"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The events of a task, folded by key and time a batch at a time."""
    for batch in batches:
        made = pa.Table.from_batches([batch]).group_by(["event", "table", "at"]).aggregate([(n, how) for n, how in FOLDS.items()])
        names = ["event", "table", "at", *(f"{n}_{how}" for n, how in FOLDS.items())]
        yield from made.select(names).rename_columns(batch.schema.names).cast(batch.schema).to_batches()


def _by_time(rows: np.ndarray) -> np.ndarray:
    """Rows of `_COLUMNS` folded by their times, in order."""
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    return _totals(rows, np.flatnonzero(np.diff(rows[:, 0], prepend=rows[:1, 0] - 1)))


def _totals(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row for each range of rows that begins at `starts`, with the range's first time."""
    adds = [*(_ADD[how] for how in FOLDS.values()), np.bitwise_or]
    return np.column_stack([rows[starts, 0], *(add.reduceat(rows[:, k + 1], starts) for k, add in enumerate(adds))])


class Deliveries(StatefulProcessor):
    """Holds the events of a key by slots of time, until the delivery that the earliest one opens is due."""

    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slot long", "rows binary")

    def _read(self, slot: int) -> np.ndarray:
        found = self.held.getValue((slot,))
        return np.frombuffer(found[0] if found else b"", np.int64).reshape(-1, len(_COLUMNS))

    def _hold(self, rows: np.ndarray) -> None:
        rows = _by_time(rows)
        cuts = np.flatnonzero(np.diff(rows[:, 0] // self.wait, prepend=rows[0, 0] // self.wait - 1))
        for part in np.split(rows, cuts[1:]):
            slot = int(part[0, 0] // self.wait)
            held = self._read(slot)
            self.held.updateValue((slot,), ((_by_time(np.concatenate([held, part])) if len(held) else part).tobytes(),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        some, n, first = [], 0, None
        for frame in rows:
            part = np.column_stack([frame[c].to_numpy(np.int64) for c in _COLUMNS])
            if not len(part):
                continue
            first = int(part[:, 0].min()) if first is None else min(first, int(part[:, 0].min()))
            some.append(part)
            n += len(part)
            if n >= BLOCK_ROWS:
                self._hold(np.concatenate(some))
                some, n = [], 0
        if some:
            self._hold(np.concatenate(some))
        if first is not None:
            # an earlier event than those held opens the delivery instead; the timer of the other then finds what is left
            self.handle.registerTimer(first + self.wait)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        past = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        made: list[np.ndarray] = []
        until = None  # the end of the delivery that the last of `made` has begun
        for slot in sorted(k[0] for k in self.held.keys()):
            rows, at = self._read(slot), 0
            if until is not None:
                at = int(np.searchsorted(rows[:, 0], until))
                if at:
                    made[-1] = _totals(np.concatenate([made[-1], rows[:at]]), np.zeros(1, np.int64))
            while at < len(rows) and rows[at, 0] + self.wait <= past:
                until = int(rows[at, 0]) + self.wait
                end = int(np.searchsorted(rows[:, 0], until))
                made.append(_totals(rows[at:end], np.zeros(1, np.int64)))
                at = end
            if at == len(rows):
                self.held.removeKey((slot,))
                continue
            if at:
                self.held.updateValue((slot,), (rows[at:].tobytes(),))
            self.handle.registerTimer(int(rows[at, 0]) + self.wait)
            break
        if made:
            yield self._frame(key, np.concatenate(made))

    @staticmethod
    def _frame(key: Any, rows: np.ndarray) -> pd.DataFrame:
        figures = {n: pd.array(rows[:, k + 1], "Int64") for k, n in enumerate(FOLDS)}
        for k, n in enumerate(FOLDS):
            figures[n][(rows[:, -1] >> k & 1) == 0] = pd.NA
        return pd.DataFrame({"event": pd.array([key[0]] * len(rows), object), "table": pd.array([key[1]] * len(rows), object), "first_ms": rows[:, 0], **figures})

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, wait_ms: int, late: str = "10 seconds") -> DataFrame:
    """event, table, first (time of its first event), rows, tombstones, seq, previous_generation of each delivery of a stream
    of event, table, at (timestamp) and these figures."""
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    figures = [F.col(n).cast("long").alias(n) for n in FOLDS]
    at = F.date_trunc("millisecond", F.coalesce(F.col("at").cast("timestamp"), F.timestamp_seconds(F.lit(0)))).alias("at")
    own = events.select(F.col("event").cast("string"), F.col("table").cast("string"), at, *figures)
    folded = own.mapInArrow(_folded, own.schema).withWatermark("at", late)
    known = sum((F.col(n).isNotNull().cast("long") * F.lit(1 << k) for k, n in enumerate(FOLDS)), F.lit(0).cast("long"))
    whole = [F.coalesce(n, F.lit(_NEUTRAL[how])).alias(n) for n, how in FOLDS.items()]
    timed = folded.select("event", "table", "at", F.unix_millis("at").alias("at_ms"), *whole, known.alias("known"))
    made = timed.groupBy("event", "table").transformWithStateInPandas(Deliveries(wait_ms), OUT, "append", "eventTime")
    return made.select("event", "table", F.timestamp_millis("first_ms").alias("first"), *FOLDS)

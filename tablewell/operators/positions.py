"""Rows by their place in an order: numbering, positional joins, and requests filled in order under a budget.

An order over a whole table is made by a range sort: partitions hold ranges of it, one after the other. What a row needs from
the rows before it is then a figure for each partition, so no task sees all rows. The sorted rows are stored in the shared
folder first, because a second run of a range sort may cut its ranges elsewhere.

Rows that are equal in the order's columns lie in any order; name further columns where that matters. Nulls come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import fixed

PART, AT = "part__", "at__"
_SHIFT = 33  # a row's id in Spark has its partition above these bits, and its place in it below


def _sorted(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows with the number of their partition and their place in it, stored."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    return fixed(ranged.withColumn(PART, F.shiftright(AT, _SHIFT)).withColumn(AT, F.col(AT).bitwiseAND(F.lit((1 << _SHIFT) - 1))))


def numbered(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """`df` with each row's place in the order, from 0."""
    rows = _sorted(df, order)
    counts = sorted((r[PART], r["count"]) for r in rows.groupBy(PART).count().collect())  # a row for each partition
    firsts = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(p, first) for (p, _), first in zip(counts, firsts, strict=False)], f"{PART} long, first__ long")
    return rows.join(F.broadcast(offsets), PART).withColumn(name, F.col("first__") + F.col(AT)).drop(PART, AT, "first__")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str | Column], right_order: list[str | Column], name: str = "position") -> DataFrame:
    """The first row beside the first, the second beside the second; where one side has no more rows its columns are null."""
    return numbered(left, left_order, name).join(numbered(right, right_order, name), name, "full")


def in_requests(df: DataFrame, order: list[str | Column], size: str, budget: int, name: str = "request") -> DataFrame:
    """`df` with the number of the request that each row goes into, from 0, filled in order.

    A row goes into the open request if that stays within the budget, else it opens the next. A row over the budget has a
    request of its own. Null and negative sizes count as 0.

    Where requests begin depends on all rows before. But a partition only gets to know how full the open request is, and for
    all fillings the partition's requests soon begin at the same rows; so each partition says for every row that may be its
    first beginning what it leaves behind (at most the rows that fit in one request, and one more), and these tables are
    followed from partition to partition.
    """
    rows = _sorted(df.withColumn("size__", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))), order)
    outcomes = rows.select(PART, "size__").mapInArrow(_outcomes(budget), f"{PART} long, fits long, fill long, begun long")
    table: dict[int, list[tuple[int, int, int]]] = {}
    for r in outcomes.collect():  # a partition's rows of this are at most those of one request, and only where what follows differs
        table.setdefault(r[PART], []).append((r.fits, r.fill, r.begun))
    fill, begun, entries = -1, 0, []
    for part in sorted(table):
        entries.append((part, fill, begun))
        room = budget - fill if fill >= 0 else -1
        # of the outcomes by how much fits before the first beginning, the one that this filling leads to
        _, after, more = next(o for o in sorted(table[part]) if room < o[0])
        fill, begun = (fill + after if more == 0 else after), begun + more
    starts = df.sparkSession.createDataFrame(entries, f"{PART} long, fill__ long, begun__ long")
    given = rows.join(F.broadcast(starts), PART).select(*df.columns, "size__", "fill__", "begun__")
    kinds = [to_arrow_type(f.dataType) for f in df.schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` long"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill, request = None, 0
        for batch in batches:
            if fill is None and batch.num_rows:
                fill, request = batch.column(len(kinds) + 1)[0].as_py(), batch.column(len(kinds) + 2)[0].as_py() - 1
            out = []
            for n in batch.column(len(kinds)).to_pylist():
                if fill < 0 or fill + n > budget:
                    request, fill = request + 1, n
                else:
                    fill += n
                out.append(request)
                fill = -1 if fill > budget else fill
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kinds)], pa.array(out, pa.int64())], names=[*batch.schema.names[: len(kinds)], name])

    return given.mapInArrow(number, schema)


def _outcomes(budget: int):  # noqa: ANN202
    """For each partition: (fits, fill, begun) by room left in the open request.

    With a room less than `fits` (and not less than the one before) the partition begins `begun` requests and leaves the last
    one filled with `fill`, or closed if that is -1; with begun = 0, `fill` is what it adds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sizes = None, []
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                sizes.append(np.asarray(batch.column(1), np.int64))
        if part is None:
            return
        size = np.concatenate(sizes)
        n, total = len(size), np.concatenate([[0], np.cumsum(size)])
        # where a request that begins at a row ends: it takes rows while their sum is within the budget, and one at least
        end = np.maximum(np.searchsorted(total, total[:-1] + budget, "right") - 1, np.arange(n) + 1)
        begun, fill = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        for k in range(n - 1, -1, -1):
            e = int(end[k])
            begun[k] = begun[e] + 1
            last = int(total[e] - total[k])
            fill[k] = fill[e] if e < n else (-1 if last > budget else last)
        first = int(np.searchsorted(total, budget, "right"))
        rows = []
        for k in range(min(n, first)):
            # the first request begins at row k if the rows before it fit, and with it they don't
            if k and not size[k]:
                continue
            o = (int(total[k + 1]), int(fill[k]), int(begun[k]))
            if rows and rows[-1][1:] == o[1:]:
                rows.pop()
            rows.append(o)
        if total[n] <= budget:
            rows.append((1 << 62, int(total[n]), 0))
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=[PART, "fits", "fill", "begun"])

    return run

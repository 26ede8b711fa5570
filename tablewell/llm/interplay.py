"""Filter interaction audit (operator 13): what each filter removes, in every order that filters can be applied.

Texts are read once. Each filter then is a relation of the ids that fail it, stored on its own, as are the ids of each
label. What a filter removes after a prefix of other filters are the ids of its relation that a left-anti join
with each relation of the prefix leaves; what is lost of a label is what a left-semi join with the label's ids leaves of
that. The prefixes share one lattice: a step joins one filter's relation, and every row that isn't in it goes on twice, with
and without that filter in its prefix. So five joins give the removals of all 80 pairs of a prefix set and a filter. What
goes through the lattice is shuffled once, before it grows; each join finds it dealt by id. An order only matters through the sets of its prefixes. Redundant ids are
those of the relation that aren't removed, survivors those that no filter up to a step removed.

Rows have ids of their own, so documents with one doc_id count apart. Defined results: null text is empty and fails no
filter but A and perhaps E; null source is the part ''; a row without doc_id fails E by no other row, makes none fail and has no label;
repeated rows have equal ids, so none is smaller and none fails by the other; documents without a label have none, with
several labels any of them counts; an empty table gives an empty result. Other columns aren't read. A copied text may be
that of any share of all rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_skewed, materialise, read_table, shuffle_width, slices, text_bytes, word_lists

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
MEASURED = "doc_id long, part string, text_sha256 binary, failed string"


def own_failures(raw: bytes) -> str:
    """Which of the filters A to D a text fails."""
    words, kinds = 0, set()
    for some in word_lists(raw):
        words += len(some)
        kinds.update(some)
    points = len(raw.translate(None, _CONTINUED))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    tests = (words < 200, 100 * len(kinds) < 50 * words, 100 * capitals > 2 * points, any(s in raw for s in SYMBOLS))
    return "".join(f for f, failed in zip(FILTERS, tests, strict=False) if failed)


_CONTINUED = bytes(range(0x80, 0xC0))
"""Bytes of UTF-8 that begin no code point."""


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 8 << 20):
        text, starts = text_bytes(batch.column(2))
        whole = text.tobytes()
        each = [whole[a:b] for a, b in itertools.pairwise(starts)]
        digests = pa.array([hashlib.sha256(t).digest() for t in each], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, pa.array(map(own_failures, each), pa.string())], names=["doc_id", "part", "text_sha256", "failed"])


def measured(docs: DataFrame) -> DataFrame:
    """(row, doc_id, part, text_sha256, failed) of each document; stored, so that the ids of rows stay as they are."""
    part = F.coalesce("source", F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, "text").mapInArrow(_measure, MEASURED)
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()))


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows whose text is that of a smaller doc_id."""
    first = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return join_skewed(rows, materialise(first), "text_sha256", "n").where("doc_id > first")


def failing_ids(rows: DataFrame) -> dict[str, DataFrame]:
    """For each filter the ids (row, part) that fail it."""
    found = {f: rows.where(F.contains("failed", F.lit(f))) for f in FILTERS[:-1]} | {FILTERS[-1]: later_copies(rows)}
    return {f: materialise(df.select("row", "part")) for f, df in found.items()}


def label_ids(rows: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """The ids of the good and of the toxic documents."""
    conditions = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return {name: materialise(rows.join(labels.where(c).select("doc_id"), "doc_id", "left_semi").select("row")) for name, c in conditions.items()}


def removals(failing: dict[str, DataFrame], labelled: dict[str, DataFrame]) -> DataFrame:
    """(part, filter, before, removed, good_lost, toxic_lost): what a filter removes after the set of filters `before`, as bits."""
    every = reduce(DataFrame.unionByName, (df.withColumn("filter", F.lit(f)) for f, df in failing.items()))
    kinds = {"all": every} | {name: every.join(ids, "row", "left_semi") for name, ids in labelled.items()}
    left = reduce(DataFrame.unionByName, (df.withColumn("kind", F.lit(name)) for name, df in kinds.items()))
    left = left.repartition(shuffle_width(every.sparkSession), "row").withColumn("before", F.lit(0))
    for f, ids in failing.items():
        # the row stays as it is, and once more with f in its prefix unless f is its own filter
        choice = F.when(F.col("filter") == f, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        twice = left.withColumn("used", F.explode(choice))
        other = ids.select(F.col("row").alias("other"))
        left = twice.join(other, F.col("used") & (F.col("row") == F.col("other")), "left_anti")
        left = left.withColumn("before", F.col("before") + F.when(F.col("used"), 1 << FILTERS.index(f)).otherwise(0)).drop("used")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return left.groupBy("part", "filter", "before").agg(count("all").alias("removed"), count("good").alias("good_lost"), count("toxic").alias("toxic_lost"))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter, before): 600 rows, the steps of all orders and the set of filters before each."""
    bits = lambda prefix: sum(1 << FILTERS.index(f) for f in prefix)
    return spark.createDataFrame([(o, k + 1, o[k], bits(o[:k])) for o in ORDERS for k in range(len(o))], "filter_order string, step int, filter string, before int")


def times_before(before: int) -> int:
    """In how many orders a set stands before a filter, and the others after it."""
    k = before.bit_count()
    return math.factorial(k) * math.factorial(len(FILTERS) - 1 - k)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each source, order of the filters and step."""
    spark = docs.sparkSession
    rows = measured(docs)
    gone = removals(failing_ids(rows), label_ids(rows, labels))
    pairs = [(f, m, times_before(m)) for k, f in enumerate(FILTERS) for m in range(1 << len(FILTERS)) if not m >> k & 1]
    choices = F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(m).alias("before"), F.lit(w).alias("weight")) for f, m, w in pairs))
    parts = rows.groupBy("part").agg(F.count("*").alias("total"))
    every = parts.select("part", "total", F.explode(choices).alias("c")).select("part", "total", "c.*").join(gone, ["part", "filter", "before"], "left").fillna(0)
    own = Window.partitionBy("part", "filter")
    at = lambda m: F.max(F.when(m, F.col("removed"))).over(own)
    alone = F.bit_count("before") == len(FILTERS) - 1
    every = every.withColumns({"fails": at(F.col("before") == 0), "unique_fails": at(alone), "shapley": F.sum(F.col("removed") * F.col("weight")).over(own)})
    laid = every.join(F.broadcast(steps(spark)), ["filter", "before"])
    so_far = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    kept = (F.col("total") - F.sum("removed").over(so_far)).alias("kept")
    return laid.select("part", "filter_order", "step", kept, "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_interplay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_interplay": op13_filter_interplay}
_ORDERS = ", ".join(f"('{o}')" for o in ORDERS)
ORACLES = {
    "op13_filter_interplay": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT r, doc_id, part, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
 e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
 l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 f AS (SELECT w.part AS part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
  concat(CASE WHEN len(words) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
   CASE WHEN 100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 2 * length(w.t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END,
   CASE WHEN w.doc_id > e.first THEN 'E' ELSE '' END) AS failed FROM w JOIN e ON w.t = e.t LEFT JOIN l ON w.doc_id = l.doc_id),
 s AS (SELECT o AS filter_order, k AS step, substr(o, k, 1) AS x, substr(o, 1, k - 1) AS b FROM (VALUES {_ORDERS}) v(o), range(1, 6) r(k)),
 n AS (SELECT part, failed, good, toxic, count(*) AS n FROM f GROUP BY ALL),
 p AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, x,
  sum(CASE WHEN translate(failed, b || x, '') = failed THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN contains(failed, x) AND translate(failed, b, '') = failed THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN contains(failed, x) AND translate(failed, b, '') <> failed THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN contains(failed, x) AND translate(failed, b, '') = failed THEN n * good ELSE 0 END) AS good_lost,
  sum(CASE WHEN contains(failed, x) AND translate(failed, b, '') = failed THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM p"""
}

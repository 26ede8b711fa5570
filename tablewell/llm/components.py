"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _least(down)
    linked = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b); the root is the smallest node that can be reached.

    Each round costs two joins on the nodes; the number of rounds grows with the logarithm of the longest path. A node
    with very many edges meets one row in each join, so skewed partitions can be split. Loops and repeated edges are
    harmless; an empty table gives an empty result.
    """
    proper = lambda e: e.where("a <> b").distinct()
    edges = materialise(proper(edges.select("a", "b")))
    before = None
    while True:
        edges = materialise(proper(_small_star(proper(_large_star(edges)))))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
        before = now

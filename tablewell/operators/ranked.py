"""The first k rows of a keyword query, by reading only blocks of postings that can hold one of them.

Rows are dealt to blocks in the order of their length, so rows of a block score alike: short rows, whose words weigh most,
lie together. Postings are stored by term and block, and each (term, block) has the greatest weight that the term has
in a row of the block. A row can't score more than the sum of these over the query's terms. A query first scores the
blocks of greatest bound, as many as hold k matching rows; their k-th score is a floor, and only blocks whose bound reaches
it are read after that. Which blocks are read never changes the result: it is that of scoring all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.search import B, K1, query_terms
from ..manifest import FullText
from .positions import numbered

MARGIN = 1e-9
"""Bounds are raised by this share, so that sums in another order don't lose a row."""


@dataclass
class RankedIndex:
    """Stored postings (term, block, row, tf, length), and the bounds of their blocks."""

    spark: SparkSession
    at: str
    settings: FullText

    @staticmethod
    def build(terms: DataFrame, sizes: DataFrame, row_id: str, settings: FullText, at: str, block_rows: int = 4096) -> RankedIndex:
        """From the terms (row id, term, tf, length) and lengths (row id, length) of all rows, as `search.index` and
        `search.lengths` give them."""
        spark = terms.sparkSession
        rows = sizes.count()
        blocks = max(1, -(-rows // block_rows))
        # places from one range sort, so that blocks, of which there are many, are neither tasks nor files
        dealt = numbered(sizes.select(F.col(row_id).alias("row"), "length"), ["length", "row"], "place")
        dealt.select("row", F.floor(F.col("place") / block_rows).cast("int").alias("block"), "length").write.parquet(f"{at}/rows")
        placed = spark.read.parquet(f"{at}/rows")
        postings = terms.select("term", F.col(row_id).alias("row"), "tf").join(placed, "row")
        # by hash, because the samples of a range sort would make all postings once more
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        postings.repartition(width, "term", "block").sortWithinPartitions("term", "block", "row").select("term", "block", "row", "tf", "length").write.parquet(f"{at}/postings")
        mean = placed.agg(F.avg("length")).first()[0] or 1.0
        stored = spark.read.parquet(f"{at}/postings")
        bounds = stored.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(weight(mean)).alias("top"))
        bounds.sortWithinPartitions("term", "block").write.parquet(f"{at}/bounds")
        spark.createDataFrame([(rows, float(mean), blocks)], "n long, mean double, blocks int").write.parquet(f"{at}/corpus")
        return RankedIndex(spark, at, settings)

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{kind}")

    def top(self, words: str, k: int) -> tuple[DataFrame, dict]:
        """(row, score) of the k best rows, ties by row, and figures: blocks with a term of the query, and blocks read."""
        terms = query_terms(words, self.settings)
        corpus = self._read("corpus").first()
        bounds = self._read("bounds").where(F.col("term").isin(*terms) if terms else F.lit(False))
        df_of = {r.term: r.n for r in bounds.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term asked
        if not df_of:
            return self._read("postings").select("row", F.lit(0.0).alias("score")).limit(0), {"blocks": 0, "read": 0}
        idf = F.create_map(*(F.lit(x) for t, n in df_of.items() for x in (t, _idf(corpus.n, n))))[F.col("term")]
        most = bounds.groupBy("block").agg((F.sum(idf * F.col("top")) * (1 + MARGIN)).alias("bound"), F.max("n").alias("at_least"))
        # the best blocks that hold k rows of some one term between them, at most k of them
        first, held = [], 0
        for r in most.orderBy(F.desc("bound"), "block").limit(k).collect():
            first.append(r.block)
            held += r.at_least
            if held >= k:
                break
        scored = self._scores(first, list(df_of), idf, corpus.mean)
        best = [r.score for r in scored.orderBy(F.desc("score")).limit(k).collect()]
        floor = best[-1] if len(best) == k else 0.0
        # numbers of blocks only; they can be very many, so they are joined and no list in the plan
        read = most.where((F.col("bound") >= floor) | F.col("block").isin(*first)).select("block")
        out = self._scores(read, list(df_of), idf, corpus.mean).orderBy(F.desc("score"), "row").limit(k)
        counts = most.agg(F.count("*").alias("all"), F.count_if((F.col("bound") >= floor) | F.col("block").isin(*first)).alias("read")).first()
        return out, {"blocks": counts["all"], "read": counts["read"]}

    def _scores(self, blocks: DataFrame | list[int], terms: list[str], idf: Column, mean: float) -> DataFrame:
        mine = self._read("postings").where(F.col("term").isin(*terms))
        mine = mine.where(F.col("block").isin(*blocks)) if isinstance(blocks, list) else mine.join(blocks, "block", "left_semi")
        return mine.groupBy("row").agg(F.round(F.sum(idf * weight(mean)), 9).alias("score"))


def weight(mean: float) -> Column:
    """What a term adds to a row's score, but for its rarity."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))


def _idf(rows: int, holding: int) -> float:
    return math.log(1 + (rows - holding + 0.5) / (holding + 0.5))

"""Document fingerprints (operator 3): canonical exact digest, with DataFrame functions only.

The canonical text is NFKC-normalised, case-folded (upper, then lower case), with white space runs made one space and the
ends trimmed. Its digest is two chained XXH64 values, 128 bits. Within the buckets of equal digest the canonical bytes
are compared: the least and the greatest text of a bucket, gathered in two steps over salted sub-buckets, are the same
string or the bucket holds different texts. Where it does, each different text gets a number that lengthens its
fingerprint, so equal fingerprints mean equal canonical texts.

Only texts of documents are compared byte by byte. An edited text shares a bucket by its digest and by the SHA-256 of
its canonical bytes. NFKC comes from a library that Spark brings along, through the SQL function reflect.

The next document in descending doc_id is found by cutting the ids into ranges of about equal size, one shuffle of the texts
by range, and a window within each; the few documents at the ends of ranges are joined on.

Defined results: null text counts as empty; null doc_ids come last in descending order; rows of equal doc_id stand in the
order of their texts; a single row is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, shuffle_width

SALTS = 16
BROADCAST = 200_000
NULL_RANGES = 1024
"""Digests (of 16 bytes) that are sent to every task; more than that are joined by a shuffle."""


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    normal = F.when(plain, text).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))
    return F.trim(F.regexp_replace(F.lower(F.upper(normal)), r"(?U)[\s\x1c-\x1f]+", " "))


def _digest(canon: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("second"), canon)))))


def _sha(text: Column) -> Column:
    """SHA-256 as bytes, which take half the room of its digits."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _ranges(ids: DataFrame, n: int) -> list:
    """At most n - 1 bounds that cut the ids into ranges of about equal size."""
    got = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n).alias("b")).first()["b"] if n > 1 else None
    return sorted(set(got or []))


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds aren't over the value: first which stretch of bounds, then where in it."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    stretches = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    most = lambda within: F.size(F.filter(within, lambda b: b <= value))
    coarse = most(F.array(*(F.lit(s[0]) for s in stretches)))
    fine = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in stretches)), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + most(fine))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text of the next document in descending order of doc_id, null ones last."""
    width = shuffle_width(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = _ranges(texts.select("doc_id"), 4 * width)
    number = _range_of(F.col("doc_id"), bounds)
    # rows without an id have no order of their own, so they get one that can be cut: by a hash of their text, then by text
    last = -1 - F.pmod(F.xxhash64("text"), F.lit(NULL_RANGES)).cast("int")
    dealt = texts.select("doc_id", "text", F.when(F.col("doc_id").isNull(), last).otherwise(number).alias("range"))
    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    near = dealt.repartition(width, "range").select(
        "*",
        F.lead("text").over(order).alias("next_text"),
        F.row_number().over(order).alias("place"),
    )
    heads = near.where("place = 1").select("range", F.col("text").alias("head"))
    whole = Window.orderBy(F.col("range").desc())
    first = F.first("head").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    wrapped = heads.select("range", F.coalesce(F.lead("head").over(whole), first).alias("next_head"))
    return near.join(wrapped, "range", "left").select("doc_id", "text", F.coalesce("next_text", "next_head").alias("next_text"))


def edited(text: Column, after: Column) -> Column:
    """`text`, its last third replaced by the beginning of `after`."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - third), after.substr(F.lit(1), third))


def _differing(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Digests of `shared` under which the canonical texts of documents differ, by comparing bytes."""
    canon = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("canon"), F.monotonically_increasing_id().alias("row"))
    own = canon.select(_digest(F.col("canon")).alias("digest"), "canon", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    members = own.join(F.broadcast(shared) if shared.count() <= BROADCAST else shared, "digest", "left_semi")
    part = members.groupBy("digest", "salt").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return part.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("digest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprints of each row of `docs` (doc_id, text), of its edited text, and how like they are."""
    texts = with_next(docs).select("doc_id", "text", "next_text", edited(F.col("text"), F.col("next_text")).alias("edited"))
    canon = texts.select("*", canonical(F.col("text")).alias("c0"), canonical(F.col("edited")).alias("c1"), canonical(F.col("next_text")).alias("c2"))
    rows = materialise(
        canon.select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            _sha(F.col("edited")).alias("edited_sha256"),
            *(_digest(F.col(f"c{k}")).alias(f"d{k}") for k in range(3)),
            *(_sha(F.col(f"c{k}")).alias(f"s{k}") for k in range(3)),
        )
    )
    every = rows.select(F.explode(F.array(*(F.struct(F.col(f"d{k}").alias("digest"), F.col(f"s{k}").alias("sha")) for k in range(2)))).alias("x")).select("x.*")
    buckets = every.groupBy("digest").agg(F.count("*").alias("n"), F.min("sha").alias("low"), F.max("sha").alias("high"))
    shared = materialise(buckets.where("n > 1"))
    apart = shared.where("low <> high").select("digest").unionByName(_differing(docs, shared.select("digest"))).distinct()
    numbered = every.join(apart, "digest", "left_semi").distinct().withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("sha")))
    more = materialise(numbered)
    none = more.isEmpty()
    for k in range(3):
        if none:  # no bucket holds different texts, so no digest needs a number
            rows = rows.withColumn(f"f{k}", F.lower(F.hex(f"d{k}")))
            continue
        named = more.select(F.col("digest").alias(f"d{k}"), F.col("sha").alias(f"s{k}"), F.concat(F.lit("-"), "number").alias(f"m{k}"))
        rows = rows.join(named, [f"d{k}", f"s{k}"], "left").withColumn(f"f{k}", F.concat(F.lower(F.hex(f"d{k}")), F.coalesce(f"m{k}", F.lit(""))))
    like = lambda k: (F.col("f0") == F.col(f"f{k}")).cast("double")
    return rows.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.col("f0").alias("fingerprint"), F.col("f1").alias("edited_fingerprint"),
        like(1).alias("near_edited"), like(2).alias("near_next"),
    )


def op3_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_canonical_digest": op3_canonical_digest}
ORACLES: dict[str, str] = {}

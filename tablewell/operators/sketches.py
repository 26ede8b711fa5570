"""Approximate figures from states that can be merged: kept for each group and window, and merged over windows without the rows.

Three states of a fixed size each: distinct values (HyperLogLog), quantiles (KLL) and frequent items. The stated errors, of one
standard deviation for distinct values and with 99 % confidence for ranks: 1.04 / sqrt(2 ** LG_DISTINCT) = 0.8 % of the count
(and none to speak of under 2 ** (LG_DISTINCT - 3) values), and about 2.3 / QUANTILES ** 0.9 = 0.13 % of the rank (none while
a state has at most QUANTILES values). An item's count is exact while a state has at most 3 / 4 of ITEMS items, and else too
high by at most 3.5 / ITEMS of the rows. Merging doesn't add to these errors.

Nulls are left out; a group without values has 0 distinct ones and null quantiles; an empty table has no states. Where no item
stands out from the error, as among very many items of about equal counts, `frequent` gives an empty list.

Where a figure must have no error, `counts` keeps each item's count, as rows that are merged by adding, and `exact_quantiles`
takes from the states only the narrow range of values that holds the quantile; the rows of that range are counted.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LG_DISTINCT, QUANTILES, ITEMS = 14, 4096, 4096
DISTINCT, VALUES, FREQUENT = "distinct_state", "quantile_state", "items_state"
ITEM, COUNT = "item", "n"
# ten standard deviations of a rank
SLACK = 0.005


def states(df: DataFrame, keys: list[str | Column], distinct: str, value: str, item: str) -> DataFrame:
    """The three states of each group, in one pass over the rows."""
    return df.groupBy(*keys).agg(
        F.hll_sketch_agg(distinct, LG_DISTINCT).alias(DISTINCT),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILES).alias(VALUES),
        F.expr(f"approx_top_k_accumulate(`{item}`, {ITEMS})").alias(FREQUENT),
    )


def merged(some: DataFrame, keys: list[str | Column]) -> DataFrame:
    """States of coarser groups, or of more windows, from finer ones."""
    return some.groupBy(*keys).agg(
        F.hll_union_agg(DISTINCT).alias(DISTINCT),
        F.kll_merge_agg_double(VALUES).alias(VALUES),
        F.expr(f"approx_top_k_combine({FREQUENT}, {ITEMS})").alias(FREQUENT),
    )


def distinct_count() -> Column:
    return F.hll_sketch_estimate(DISTINCT)


def quantile(rank: float) -> Column:
    """The least value whose rank reaches this share; null where there are no values."""
    return F.when(F.kll_sketch_get_n_double(VALUES) > 0, F.kll_sketch_get_quantile_double(VALUES, F.lit(rank)))


def frequent(k: int) -> Column:
    """The k most frequent items as (item, count), most frequent first."""
    return F.expr(f"approx_top_k_estimate({FREQUENT}, {k})")


def counts(df: DataFrame, keys: list[str | Column], item: str) -> DataFrame:
    """A state that has no error and grows with the items: the count of each item of a group, null being one."""
    return df.groupBy(*keys, F.col(item).alias(ITEM)).agg(F.count("*").alias(COUNT))


def merged_counts(some: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Counts of coarser groups, or of more windows, from finer ones."""
    return some.groupBy(*keys, ITEM).agg(F.sum(COUNT).alias(COUNT))


def _beside(rows: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join by keys, of which null is one."""
    named = some.withColumnsRenamed({k: f"{k}__" for k in keys})
    return rows.join(named, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys))).drop(*(f"{k}__" for k in keys))


def exact_quantiles(df: DataFrame, whole: DataFrame, keys: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """For each group of `df` that has values, under each name of `ranks` the least value whose rank reaches that share.

    `whole` has the states of these groups. They give a range for each quantile; one pass counts the rows below and in it, a
    second one the values in it. A range that turns out not to hold its quantile is opened to all values.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("value__")).where("value__ is not null")
    shares = {name: float(rank) for name, rank in ranks.items()}
    ends = {f"{name}__{k}": quantile(min(max(r + d, 0.0), 1.0)) for name, r in shares.items() for k, d in (("low", -SLACK), ("high", SLACK))}
    ranged = _beside(rows, whole.select(*keys, *(c.alias(n) for n, c in ends.items())), keys)
    v = F.col("value__")
    within = lambda n: (v >= F.col(f"{n}__low")) & (v <= F.col(f"{n}__high"))
    seen = [F.count_if(c).alias(f"{n}__{k}") for n in ranks for k, c in (("below", v < F.col(f"{n}__low")), ("in", within(n)))]
    first = ranged.groupBy(*keys, *ends).agg(F.count("*").alias(COUNT), *seen)

    def found(name: str, rank: str) -> Column:
        at = F.ceil(F.lit(Decimal(rank)) * F.col(COUNT).cast("decimal(20,0)")).cast("long")
        at = F.greatest(at, F.lit(1).cast("long"))
        below = F.col(f"{name}__below")
        good = (below < at) & (at <= below + F.col(f"{name}__in"))
        end = lambda k: F.when(good, F.col(f"{name}__{k}"))
        return F.struct(F.lit(name).alias("name"), end("low").alias("low"), end("high").alias("high"), F.when(good, at - below).otherwise(at).alias("at"))

    sought = first.select(*keys, F.array(*(found(n, r) for n, r in ranks.items())).alias("sought"))
    holds = lambda s: s["low"].isNull() | ((v >= s["low"]) & (v <= s["high"]))
    near = _beside(rows, sought, keys).select(*keys, "value__", F.explode(F.filter("sought", holds)).alias("s"))
    counted = near.groupBy(*keys, "s.name", "s.at", "value__").agg(F.count("*").alias(COUNT))
    upto = F.sum(COUNT).over(Window.partitionBy(*keys, "name").orderBy("value__").rowsBetween(Window.unboundedPreceding, 0))
    reached = counted.withColumn("upto", upto).where("upto >= at")
    return reached.groupBy(*keys).agg(*(F.min(F.when(F.col("name") == n, v)).alias(n) for n in ranks))

"""Places in an order, requests filled in order, and states that merge, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tablewell.operators import positions, sketches


def plain_requests(sizes, budget):
    out, request, fill = [], -1, None
    for n in sizes:
        n = max(0, n or 0)
        if fill is None or fill + n > budget:
            request, fill = request + 1, 0
        fill += n
        out.append(request)
        fill = None if fill > budget else fill
    return out


@pytest.mark.parametrize("sizes", [[5, 5, 5], [0, 0, 11, 0, 0, 3], [10] * 9, [1] * 60, [None, -3, 10, 1], [], [30], "many", "long"])
def test_requests_are_those_of_one_pass(spark, sizes):
    rng = random.Random(6)
    if sizes == "many":
        sizes = [rng.choice([0, 1, 2, 3, 9, 10, 11, 40, None]) for _ in range(700)]
    if sizes == "long":
        sizes = [rng.randrange(0, 3) for _ in range(900)]
    rows = [(k, n) for k, n in enumerate(sizes)]
    rng.shuffle(rows)
    got = positions.in_requests(spark.createDataFrame(rows, "k long, n int").repartition(3), ["k"], "n", 10).orderBy("k").collect()
    assert [r.request for r in got] == plain_requests(sizes, 10)
    assert [r.n for r in got] == sizes


def test_places_are_those_of_the_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]), k) for k in range(500)]
    got = positions.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", F.desc("b")]).orderBy("position").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert [(r.a, r.b) for r in got] == want and [r.position for r in got] == list(range(500))
    plan = positions.numbered(spark.createDataFrame(rows, "a int, b int"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def test_the_longer_side_of_a_positional_join_goes_on(spark):
    a, b = spark.createDataFrame([(k,) for k in "cab"], "x string"), spark.createDataFrame([(3,), (1,)], "y int")
    got = positions.positional_join(a, b, ["x"], [F.desc("y")]).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(0, "a", 3), (1, "b", 1), (2, "c", None)]
    assert positions.positional_join(a.limit(0), b.limit(0), ["x"], ["y"]).count() == 0


def test_merged_states_answer_as_the_rows_do(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 24).alias("hour"), F.xxhash64("id").bitwiseAND(F.lit(0x7FFF)).alias("user"), (F.col("id") * 0.5).alias("value"), F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id") % 1000).alias("item"))
    both = sketches.merged(sketches.merged(sketches.states(rows, ["g", "hour"], "user", "value", "item"), ["g", (F.col("hour") / 6).cast("int").alias("part")]), ["g"])
    exact = {r.g: r for r in rows.groupBy("g").agg(F.count_distinct("user").alias("users"), F.count("*").alias("n"), F.count_if(F.col("item") == 7).alias("sevens")).collect()}
    for r in both.select("g", sketches.distinct_count().alias("users"), sketches.quantile(0.5).alias("median"), sketches.frequent(2).alias("top")).collect():
        e = exact[r.g]
        assert abs(r.users - e.users) < 0.03 * e.users
        assert abs(r.median - 50_000) < 0.004 * 100_000
        assert (r.top[0].item, r.top[0]["count"]) == (7, e.sevens)


def test_states_of_nulls(spark):
    none = spark.createDataFrame([(1, None, None, None), (2, 5, 1.5, 5)], "g int, u long, v double, i long")
    got = sketches.merged(sketches.states(none, ["g"], "u", "v", "i"), ["g"]).orderBy("g").select(sketches.distinct_count().alias("n"), sketches.quantile(0.5).alias("m"))
    assert [tuple(r) for r in got.collect()] == [(0, None), (1, 1.5)]
    assert sketches.states(none.limit(0), ["g"], "u", "v", "i").count() == 0


def test_sketch_windows_has_no_error_over_more_users_than_a_state_holds(spark, tmp_path):
    """Users of about equal counts, of whom none stands out from the error of a state, and more values than it holds."""
    duckdb = pytest.importorskip("duckdb")
    from tablewell.plans import memory

    at = "timestamp'2024-05-01 00:00:00' + make_dt_interval(0, id % 5)"
    kind = "case when id % 1000 = 3 then null when id % 1000 = 4 then 'none' when id % 3 = 0 then 'a' else 'b' end"
    rows = spark.range(60_000).selectExpr("id as event_id", f"cast({at} as timestamp_ntz) as ts", "if(id % 100 = 7, null, id % 20011) as user_id", f"{kind} as event_type", "if(id % 1000 = 4 or id % 50 = 1, null, cast(xxhash64(id) % 30000 as double) / 7) as value")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, memory.sketch_windows(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(memory.ORACLES["sketch_windows"]).fetchall(), key=str)


def test_ranges_that_miss_their_quantile_are_opened(spark):
    rows = spark.range(1000).selectExpr("id % 2 as g", "cast(id as double) as v")
    other = sketches.states(rows.withColumn("v", F.col("v") + 5000).withColumn("i", F.lit(1)), ["g"], "i", "v", "i")
    got = sketches.exact_quantiles(rows, other, ["g"], "v", {"m": "0.5", "all": "1", "least": "0"}).orderBy("g").collect()
    assert [tuple(r) for r in got] == [(0, 498.0, 998.0, 0.0), (1, 499.0, 999.0, 1.0)]

"""Relational queries over the standard tables. Where Spark and DuckDB read the same text alike, one text serves both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    # joins
    "join_inner": (("customer", "orders"), "SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey, o.o_orderstatus AS o_orderstatus FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"),
    "join_three_way": (
        ("lineitem", "orders", "customer"),
        "SELECT c.c_mktsegment AS segment, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(l.l_extendedprice * (1 - l.l_discount)) AS DOUBLE), 1) AS revenue "
        "FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment",
    ),
    "join_left": (("customer", "orders"), "SELECT c.c_custkey AS c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey"),
    "join_full": (
        ("documents", "labels"),
        "SELECT CAST(coalesce(d.doc_id, l.doc_id) AS BIGINT) AS doc_id, l.quality IS NULL AS unlabelled FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "join_using": (("documents", "labels"), "SELECT doc_id, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)"),
    "join_expression_key": (("nation", "region"), "SELECT n.n_name AS n_name, r.r_name AS r_name FROM nation n JOIN region r ON concat('r:', CAST(r.r_regionkey AS VARCHAR(10))) = concat('r:', CAST(n.n_regionkey AS VARCHAR(10)))"),
    "join_self_arithmetic": (("events",), "SELECT a.event_id AS event_id, b.event_type AS before FROM events a JOIN events b ON a.event_id = b.event_id + 1 WHERE a.event_type = 'error'"),
    "join_cross": (("region", "nation"), "SELECT r.r_name AS r_name, n.n_name AS n_name FROM region r CROSS JOIN nation n WHERE r.r_regionkey < 2"),
    "join_anti": (("customer", "orders"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "join_semi": (("customer", "orders"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "join_right": (("orders", "customer"), "SELECT c.c_custkey AS c_custkey, CAST(count(o.o_orderkey) AS BIGINT) AS n FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey"),
    "join_natural": (("documents", "labels"), "SELECT doc_id, quality, n_chars FROM documents NATURAL JOIN labels"),
    "join_lateral": (
        ("customer", "orders"),
        "SELECT c.c_custkey AS c_custkey, t.n AS n, t.last_key AS last_key FROM customer c, LATERAL (SELECT CAST(count(*) AS BIGINT) AS n, max(o.o_orderkey) AS last_key FROM orders o WHERE o.o_custkey = c.c_custkey) t",
    ),
    # aggregation
    "agg_count": (("lineitem",), "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem"),
    "agg_filter": (("lineitem",), "SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity > 25) AS BIGINT) AS large, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_ordinal": (("lineitem",), "SELECT l_linestatus, CAST(max(l_linenumber) AS BIGINT) AS top, round(CAST(min(l_extendedprice) AS DOUBLE), 2) AS low FROM lineitem GROUP BY 1"),
    "agg_distinct": (("lineitem",), "SELECT CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem"),
    "agg_having": (("orders",), "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15"),
    "agg_argmax": (("events",), "SELECT user_id, max_by(event_type, event_id) AS last_type, CAST(max(event_id) AS BIGINT) AS last_id FROM events GROUP BY user_id"),
    "agg_rollup": (
        ("orders",),
        "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    ),
    "agg_cube": (("orders",), "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "agg_grouping_sets": (("orders",), "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "agg_statistics": (("lineitem",), "SELECT l_returnflag, round(CAST(avg(l_quantity) AS DOUBLE), 4) AS mean, round(stddev_samp(CAST(l_quantity AS DOUBLE)), 4) AS spread FROM lineitem GROUP BY l_returnflag"),
    "select_distinct": (("orders",), "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders"),
    "top_group": (("events",), "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 1"),
    # windows
    "win_rank": (
        ("orders",),
        "SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    ),
    "win_distribution": (
        ("orders",),
        "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    ),
    "win_lag": (("events",), "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"),
    "win_frame": (
        ("events",),
        "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent, "
        "first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS first_type FROM events",
    ),
    "win_range": (("events",), "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 200 PRECEDING AND CURRENT ROW), 4) AS recent, CAST(count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 200 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events"),
    "win_nth": (("events",), "SELECT event_id, nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_type FROM events"),
    "win_running_sum": (("orders",), "SELECT o_orderkey, round(CAST(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 2) AS running FROM orders"),
    "top1_per_group": (
        ("orders",),
        "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1",
    ),
    # sorting, paging, sets, subqueries
    "topk_nulls_last": (("events",), "SELECT event_id, event_type FROM events ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE event_type END NULLS LAST, event_id DESC LIMIT 25"),
    "set_union": (("customer", "supplier"), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_union_all": (("customer", "supplier"), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "set_intersect": (("customer", "supplier"), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
    "set_intersect_all": (("customer", "supplier"), "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "set_except_all": (("customer", "supplier"), "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "set_except": (("part", "lineitem"), "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45"),
    "cte": (("orders",), "WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT CAST(count(*) AS BIGINT) AS n FROM spent WHERE total > 1000000"),
    "cte_recursive": (("conversations",), "WITH RECURSIVE t(conv_id, turn, depth) AS (SELECT conv_id, turn, CAST(0 AS BIGINT) FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, t.depth + 1 FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.turn + 1) SELECT conv_id, turn, depth FROM t"),
    "subquery_scalar": (("orders",), "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)"),
    "subquery_in": (("orders", "customer"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    # scalars
    "scalar_strings": (("customer",), "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, c_name || '/' || c_mktsegment AS both_, substr(c_mktsegment, 1, 2) AS code FROM customer WHERE c_name LIKE '%1%'"),
    "scalar_case": (("orders",), "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders"),
    "predicates": (("lineitem",), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R') AND NOT (l_linestatus = 'O') AND l_shipdate IS NOT NULL"),
    "tpch_q1": (
        ("lineitem",),
        "SELECT l_returnflag, l_linestatus, round(CAST(sum(l_quantity) AS DOUBLE), 2) AS sum_qty, round(CAST(sum(l_extendedprice) AS DOUBLE), 1) AS sum_base, "
        "round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 1) AS sum_disc, round(CAST(avg(l_discount) AS DOUBLE), 4) AS avg_disc, CAST(count(*) AS BIGINT) AS n "
        "FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
}


def _shared(names: tuple[str, ...], sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in names:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(sql)

    return run


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: events within an hour after an error of the same user. The hour of both sides is an equi key, so
    only rows of the same or the next hour are compared."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    errors = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("from_ts"))
    hour = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 3600)
    spans = errors.withColumn("slot", F.explode(F.array(hour("from_ts"), hour("from_ts") + 1)))
    later = e.withColumn("slot", hour("ts"))
    met = spans.join(later, ["user_id", "slot"]).where("ts > from_ts AND ts <= from_ts + INTERVAL 1 HOUR")
    return met.select("error_id", "event_id", "event_type")


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the user's last purchase before it: one window over the rows of both, no pairs."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = e.withColumn("purchase_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'error'").select("event_id", "purchase_id")


def array_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined to the elements of a JSON array that another row holds."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_set("l_partkey"))).alias("parts"))
    each = lists.select("l_orderkey", F.explode(F.from_json("parts", "array<bigint>")).alias("p_partkey"))
    return each.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"))


def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.median(F.col("l_extendedprice").cast("double")), 3).alias("median"))


def agg_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's count, told by whether it's within 5 % of the exact one."""
    n = table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n"), F.count_distinct("l_partkey").alias("exact"))
    return n.select("exact", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


def exploded_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum over the elements of arrays."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("lines"))
    return lists.select("l_orderkey", F.explode("lines").alias("line")).groupBy("l_orderkey").agg(F.sum("line").cast("bigint").alias("total"))


def quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice").cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile(x, 0.9), 3).alias("p90"), F.mode("l_linenumber", deterministic=True).cast("bigint").alias("line"))


def string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "view"]
    out = table(spark, sf_dir, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id"))
    return out.fillna(0)


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    old, new = e.where("event_id % 2 = 0").select("event_id", "event_type"), e.where("event_id % 2 = 1").select("value", "event_type", "event_id")
    return old.unionByName(new, allowMissingColumns=True).select("event_id", "event_type", F.round("value", 4).alias("value"))


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return e.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.max(F.hour("ts")).cast("bigint").alias("last_hour"))


def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of the numbers up to one that a column holds."""
    return table(spark, sf_dir, "orders").select(F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("o_orderkey") % 3).cast("bigint"))).alias("k"), F.col("o_orderkey").alias("id"))


def distinct_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.size(F.collect_set("event_type").over(w)).cast("bigint").alias("kinds"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _shared(*spec) for name, spec in SHARED.items()},
    "join_range": join_range,
    "as_of_join": as_of_join,
    "join_array_membership": array_membership,
    "agg_median": agg_median,
    "agg_lists": agg_lists,
    "agg_approx_distinct": approx_distinct,
    "agg_exploded_sum": exploded_sum,
    "agg_quantile": quantile,
    "agg_string": string_lists,
    "agg_pivot": pivot,
    "set_union_by_name": union_by_name,
    "date_functions": date_functions,
    "generated_rows": generated_rows,
    "win_distinct": distinct_in_window,
}

ORACLES: dict[str, str] = {
    **{name: sql for name, (_, sql) in SHARED.items()},
    "join_range": "SELECT a.event_id AS error_id, b.event_id AS event_id, b.event_type AS event_type FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'error'",
    "as_of_join": "SELECT event_id, purchase_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS purchase_id FROM events) t WHERE event_type = 'error'",
    "join_array_membership": "SELECT p_brand, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "agg_median": "SELECT l_returnflag, round(median(CAST(l_extendedprice AS DOUBLE)), 3) AS median FROM lineitem GROUP BY l_returnflag",
    "agg_lists": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "agg_approx_distinct": "SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS exact, true AS close FROM lineitem",
    "agg_exploded_sum": "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY l_orderkey",
    "agg_quantile": "SELECT l_returnflag, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.9), 3) AS p90, CAST((SELECT l_linenumber FROM lineitem m WHERE m.l_returnflag = l.l_returnflag GROUP BY l_linenumber ORDER BY count(*) DESC, l_linenumber LIMIT 1) AS BIGINT) AS line FROM lineitem l GROUP BY l_returnflag",
    "agg_string": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "agg_pivot": "SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS error, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS view FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY user_id",
    "set_union_by_name": "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN NULL ELSE round(value, 4) END AS value FROM events",
    "date_functions": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(count(*) AS BIGINT) AS n, CAST(max(hour(ts)) AS BIGINT) AS last_hour FROM events GROUP BY 1",
    "generated_rows": "SELECT CAST(unnest(generate_series(0, o_orderkey % 3)) AS BIGINT) AS k, o_orderkey AS id FROM orders",
    "win_distinct": "SELECT e.event_id AS event_id, k.kinds AS kinds FROM events e JOIN (SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds FROM events GROUP BY user_id) k ON e.user_id = k.user_id",
}

"""Registered queries on the star schema and the events: the general operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarnwell.plans.base import query, table
from skarnwell.streaming import watch


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill({"orders": 0})


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def join_full(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").na.fill(0)


@query("SELECT p_brand, count(*) AS n FROM part JOIN (SELECT p_brand AS b, avg(p_retailprice) AS m FROM part GROUP BY 1) ON p_brand = b AND p_retailprice > m GROUP BY p_brand")
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_retailprice")
    m = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("m"))
    return p.join(m, "p_brand").filter("p_retailprice > m").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) < (e.ts, e.event_id)) AS purchase FROM events e WHERE false
    UNION ALL SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) FROM events""")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the last purchase of its user before it: an as-of join as one window, without a join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("purchase"))


AGG = "count(*) AS n, round(sum(l_quantity), 2) AS quantity"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")


@query(f"SELECT l_returnflag, l_linestatus, {AGG} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"SELECT l_returnflag, l_linestatus, {AGG} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    from skarnwell.operators.evaluate import latency

    return latency(table(spark, d, "events"), "event_type", "value").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT o_orderkey, rank FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def win_rank(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 3")


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def win_lag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS n FROM events")
def win_frame(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)).alias("n"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ev_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return watch.tumbling(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT b - INTERVAL (30 * k) MINUTE AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS b, unnest([0, 1]) AS k FROM events) GROUP BY ALL")
def ev_sliding(spark: SparkSession, d: str) -> DataFrame:
    return watch.tumbling(table(spark, d, "events"), "ts", ["event_type"], "value", "1 hour", slide="30 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, session""")
def ev_session(spark: SparkSession, d: str) -> DataFrame:
    return watch.sessions(table(spark, d, "events"), "ts", "user_id", "2 hours").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))

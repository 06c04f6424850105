"""Relational operations over array views: what Spark adds to the array operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query
from .views import EV, ev1d, table


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_custkey, rank FROM (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(best).alias("rank")).where("rank <= 3")


@query(f"SELECT step, d0, value, last_value(CASE WHEN value > 200 THEN value END IGNORE NULLS) OVER (PARTITION BY step ORDER BY d0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_peak FROM {EV}")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell with the latest peak of its step at or before it."""
    before = Window.partitionBy("step").orderBy("d0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peak = F.last(F.when(F.col("value") > 200, F.col("value")), ignorenulls=True).over(before)
    return ev1d(spark, sf_dir).select("step", "d0", "value", peak.alias("last_peak"))


_GAPS = "(SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)"


@query(f"SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM {_GAPS}) GROUP BY user_id, session")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return sessions.select("user_id", "first_ts", "n")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return days.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT r_name, n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))

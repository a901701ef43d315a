"""Relational reports over the business tables with the library's operators: top-k, windows, joins, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return li.agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3""")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("""SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS suppliers, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def suppliers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    g = table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"))
    return g.withColumn("percent", F.round(100.0 * F.col("suppliers") / F.sum("suppliers").over(Window.partitionBy()), 4))


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS value FROM s GROUP BY ALL""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after six hours without an event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("fresh", F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 6 HOURS")).cast("int"), F.lit(1)))
    s = e.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS next_role FROM conversations)
SELECT conv_id, turn, md5(text) AS question, md5(answer) AS answer FROM m WHERE role = 'user' AND next_role = 'assistant'""")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the answer that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"))
    return m.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.md5("text").alias("question"), F.md5("answer").alias("answer"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ROLLUP (day, event_type)""")
def events_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").rollup("day", "event_type").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT e.event_id, e.user_id, p.event_id AS before, row_number() OVER (PARTITION BY e.event_id ORDER BY p.ts DESC, p.event_id DESC) AS n FROM events e JOIN events p ON p.user_id = e.user_id AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id < e.event_id)) AND p.event_type = 'click' WHERE e.event_type = 'purchase')
SELECT event_id, user_id, before FROM q WHERE n = 1""")
def last_click_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by one running window instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w).alias("before"))
    return e.where("event_type = 'purchase' AND before IS NOT NULL").select("event_id", "user_id", "before")

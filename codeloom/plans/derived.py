"""Graphs derived from the driver tables, and the same graphs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph, tasks_for
from ..sources.tables import table


def _edge(df: DataFrame, src: str, s, dst: str, d, kind: str, confidence=None) -> DataFrame:
    c = F.lit(1.0) if confidence is None else confidence
    return df.select(F.concat(F.lit(f"{src}:"), s).alias("src"), F.concat(F.lit(f"{dst}:"), d).alias("dst"), F.lit(kind).alias("type"), c.cast("double").alias("confidence"))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers, orders, parts, suppliers, nations and regions as one typed graph."""
    t = lambda name: table(spark, sf_dir, name)
    li, part = t("lineitem"), F.col
    tasks = tasks_for(li)
    edges = (
        _edge(t("orders"), "Order", part("o_orderkey"), "Customer", part("o_custkey"), "PLACED_BY")
        .unionByName(_edge(li.repartition(tasks, "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("c")), "Order", part("l_orderkey"), "Part", part("l_partkey"), "CALLS", part("c")))
        .unionByName(_edge(li.select("l_partkey", "l_suppkey").repartition(tasks, "l_partkey", "l_suppkey").distinct(), "Part", part("l_partkey"), "Supplier", part("l_suppkey"), "CALLS"))
        .unionByName(_edge(t("customer"), "Customer", part("c_custkey"), "Nation", part("c_nationkey"), "MEMBER_OF"))
        .unionByName(_edge(t("supplier"), "Supplier", part("s_suppkey"), "Nation", part("s_nationkey"), "MEMBER_OF"))
        .unionByName(_edge(t("nation"), "Nation", part("n_nationkey"), "Region", part("n_regionkey"), "CONTAINS"))
    )
    node = lambda df, label, key, name: df.select(F.concat(F.lit(f"{label}:"), key).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"))
    nodes = (
        node(t("customer"), "Customer", part("c_custkey"), "c_name")
        .unionByName(node(t("orders"), "Order", part("o_orderkey"), "o_orderkey"))
        .unionByName(node(t("part"), "Part", part("p_partkey"), "p_name"))
        .unionByName(node(t("supplier"), "Supplier", part("s_suppkey"), "s_name"))
        .unionByName(node(t("nation"), "Nation", part("n_nationkey"), "n_name"))
        .unionByName(node(t("region"), "Region", part("r_regionkey"), "r_name"))
    )
    return Graph(nodes, edges, tasks)


TRADE_SQL = """
trade_edges AS (
  SELECT 'Order:' || o_orderkey AS src, 'Customer:' || o_custkey AS dst, 'PLACED_BY' AS type, 1.0::DOUBLE AS confidence FROM orders
  UNION ALL SELECT 'Order:' || l_orderkey, 'Part:' || l_partkey, 'CALLS', max(round(1 - l_discount, 2)) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'Part:' || l_partkey, 'Supplier:' || l_suppkey, 'CALLS', 1.0::DOUBLE FROM lineitem
  UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'MEMBER_OF', 1.0::DOUBLE FROM customer
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'MEMBER_OF', 1.0::DOUBLE FROM supplier
  UNION ALL SELECT 'Nation:' || n_nationkey, 'Region:' || n_regionkey, 'CONTAINS', 1.0::DOUBLE FROM nation),
trade_nodes AS (
  SELECT 'Customer:' || c_custkey AS id, 'Customer' AS label, c_name AS name FROM customer
  UNION ALL SELECT 'Order:' || o_orderkey, 'Order', o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name FROM supplier
  UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name FROM nation
  UNION ALL SELECT 'Region:' || r_regionkey, 'Region', r_name FROM region)"""


def succession_edges(spark: SparkSession, sf_dir: str, priority: str | None = None) -> DataFrame:
    """Customer of an order -> customer of the next order, per month so that no window spans the table.

    One edge per (src, dst, type) with the largest confidence; no loops.
    """
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))).orderBy("o_orderdate", "o_orderkey")
    nxt = o.withColumn("nxt", F.lead("o_custkey").over(w)).where("nxt IS NOT NULL AND nxt <> o_custkey")
    e = nxt.select(F.col("o_custkey").cast("string").alias("src"), F.col("nxt").cast("string").alias("dst"), F.col("o_orderpriority").alias("type"), F.round(F.col("o_totalprice") / (F.col("o_totalprice") + 100000), 4).alias("confidence"))
    e = e.where(F.col("type").startswith(priority)) if priority else e
    return e.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def succession_sql(priority: str | None = None) -> str:
    only = f"AND o_orderpriority LIKE '{priority}%'" if priority else ""
    return f"""
succ AS (SELECT src, dst, type, max(confidence) AS confidence FROM (
  SELECT o_custkey::VARCHAR AS src, nxt::VARCHAR AS dst, o_orderpriority AS type, round(o_totalprice / (o_totalprice + 100000), 4) AS confidence
  FROM (SELECT *, lead(o_custkey) OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders)
  WHERE nxt IS NOT NULL AND nxt <> o_custkey {only}) GROUP BY src, dst, type)"""


def sessions(spark: SparkSession, sf_dir: str, gap_minutes: int = 30) -> DataFrame:
    """Events with session (user and number of the session) and step (from 1)."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(w) > F.expr(f"INTERVAL {gap_minutes} MINUTES"), F.lit(True))
    marked = e.withColumn("s", F.sum(gap.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    named = marked.withColumn("session", F.concat_ws("_", F.lit("proc"), "user_id", "s"))
    return named.withColumn("step", F.row_number().over(Window.partitionBy("session").orderBy("ts", "event_id"))).select("event_id", "ts", "user_id", "event_type", "value", "session", "step")


SESSIONS_SQL = """
sess AS (SELECT event_id, ts, user_id, event_type, value, session, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS step FROM (
  SELECT *, 'proc_' || user_id || '_' || sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS g FROM events)))"""

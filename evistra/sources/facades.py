"""Loaders, and the views of the driver's tables that stand in for business entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The same views as common table expressions, for the oracle.
ORDERS_SQL = """
first_line AS (SELECT l_orderkey, min(l_linenumber * 10000000000 + l_partkey) % 10000000000 AS partkey FROM lineitem GROUP BY 1),
v_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, p_type AS category, o_totalprice AS price,
         date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') % 31 AS days, o_orderstatus = 'F' AS refunded
  FROM orders LEFT JOIN first_line ON o_orderkey = l_orderkey LEFT JOIN part ON partkey = p_partkey),
risk AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0 GROUP BY 1),
v_customers AS (
  SELECT c_custkey AS customer_id, c_acctbal > 5000 AS gold, coalesce(n, 0) AS refund_count
  FROM customer LEFT JOIN risk ON c_custkey = o_custkey),
v_requests AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS acting_user,
         CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'no_reason' ELSE 'quality' END AS reason,
         CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'unopened' WHEN 2 THEN 'opened' ELSE 'used' END AS condition
  FROM orders)"""


def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, customer_id, category (of its first line, null without lines), price, days since receipt, refunded."""
    lines = load(spark, sf_dir, "lineitem")
    first = lines.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("partkey"))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_type")
    o = load(spark, sf_dir, "orders")
    return (
        o.join(first, o["o_orderkey"] == first["l_orderkey"], "left").join(part, F.col("partkey") == part["p_partkey"], "left")
        .select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("p_type").alias("category"), F.col("o_totalprice").alias("price"),
            (F.datediff(F.lit("2001-08-02").cast("date"), F.to_date("o_orderdate")) % 31).alias("days"), (F.col("o_orderstatus") == "F").alias("refunded"),
        )
    )


def customers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, gold, refund_count."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    risk = o.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.join(risk, c["c_custkey"] == risk["o_custkey"], "left").select(
        F.col("c_custkey").alias("customer_id"), (F.col("c_acctbal") > 5000).alias("gold"), F.coalesce("n", F.lit(0)).alias("refund_count")
    )


def requests_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, acting_user, reason, condition: one request an order, every tenth by somebody else."""
    k = F.col("o_orderkey")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(
        k.alias("order_id"), F.when(k % 10 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("acting_user"),
        pick(3, "", "no_reason", "quality").alias("reason"), pick(4, "", "unopened", "opened", "used").alias("condition"),
    )


TURNS_SQL = """
acts AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, ts, event_id, value,
  CASE event_type WHEN 'click' THEN 'get_profile' WHEN 'view' THEN 'search_policy' WHEN 'signup' THEN 'check_eligibility'
                  WHEN 'purchase' THEN 'execute_refund' WHEN 'error' THEN 'record_denial' ELSE 'handoff' END AS tool
  FROM events)"""
TOOLS = {"click": "get_profile", "view": "search_policy", "signup": "check_eligibility", "purchase": "execute_refund", "error": "record_denial"}


def with_tool(events: DataFrame) -> DataFrame:
    """events with the tool that each stands for."""
    tool = F.lit("handoff")
    for kind, name in TOOLS.items():
        tool = F.when(F.col("event_type") == kind, name).otherwise(tool)
    return events.withColumn("tool", tool)


def acts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls: user_id, day, ts, event_id, value, tool; a turn is a user's day."""
    return with_tool(load(spark, sf_dir, "events")).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", "value", "tool")

"""Turns, expectations and cases made from orders: one turn an order, a case a customer, in views and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evistra.sources.facades import load

#: The same views for the oracle. k is the order, u the customer.
EVAL_SQL = """
e_orders AS (SELECT o_orderkey AS k, o_custkey AS u, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
e_actual AS (SELECT *, CASE k % 7 WHEN 0 THEN [] WHEN 1 THEN ['get_customer_info', 'search_refund_policy']
    WHEN 2 THEN ['get_customer_info', 'search_refund_policy', 'check_refund_eligibility', 'execute_refund'] WHEN 3 THEN ['get_customer_info', 'check_refund_eligibility', 'record_refund_denial']
    WHEN 4 THEN ['check_refund_eligibility', 'handoff_to_human'] WHEN 5 THEN ['search_refund_policy', 'search_refund_policy', 'search_refund_policy', 'check_refund_eligibility']
    ELSE ['check_refund_eligibility', 'execute_refund', 'execute_refund'] END AS tools,
  CASE WHEN k % 7 < 2 THEN [] ELSE CASE k % 5 WHEN 0 THEN ['通过：可退'] WHEN 1 THEN ['参数错误：x', '不通过：超期'] WHEN 2 THEN ['通过：a', '参数错误：b'] WHEN 3 THEN ['需补充：缺'] ELSE ['参数错误：y'] END END AS verdicts,
  CASE WHEN k % 7 IN (2, 6) THEN '批准' WHEN k % 7 = 3 THEN '拒绝' END AS decision, CASE WHEN k % 7 IN (2, 3) THEN 1 WHEN k % 7 = 6 THEN 2 ELSE 0 END AS n_log,
  CASE WHEN k % 7 = 3 THEN 'D' ELSE 'R' END || (9000 + k + CASE WHEN k % 7 = 6 THEN 1 ELSE 0 END) AS receipt,
  'O' || (k + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) AS logged_order, CASE WHEN k % 7 = 3 THEN 0 ELSE price + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END END AS logged_amount,
  CASE WHEN k % 7 IN (1, 2, 5) THEN CASE WHEN k % 4 = 1 THEN ['[E1] P02 text', 'P 07 more'] ELSE ['[E1] P02 text'] END ELSE [] END AS policy FROM e_orders),
e_turns AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'no number here' WHEN k % 3 = 2 THEN 'see D9999, refund within 7days' WHEN n_log > 0 THEN 'the receipt ' || substr(receipt, 1, 3) || ' ' || substr(receipt, 4) ELSE 'wait 7 days' END AS answer,
  CASE WHEN list_contains(tools, 'handoff_to_human') THEN 'handoff' WHEN decision = '批准' THEN 'approved' WHEN decision = '拒绝' THEN 'denied' WHEN len(tools) = 0 THEN 'ask_order_id' ELSE 'clarify' END AS outcome,
  list_last(list_filter(list_transform(verdicts, lambda v: string_split(v, '：')[1]), lambda h: h IN ('通过', '不通过', '需补充'))) AS verdict FROM e_actual),
e_expected AS (SELECT k AS ek, CASE WHEN k % 4 = 0 THEN 'denied' ELSE CASE k % 7 WHEN 0 THEN 'ask_order_id' WHEN 2 THEN 'approved' WHEN 3 THEN 'denied' WHEN 4 THEN 'handoff' WHEN 6 THEN 'approved' ELSE 'clarify' END END AS expected_outcome,
  CASE WHEN k % 7 = 2 THEN ['execute_refund'] WHEN k % 7 = 3 THEN ['record_refund_denial'] WHEN k % 2 = 0 THEN ['search_refund_policy'] ELSE [] END AS must_call,
  CASE WHEN k % 5 = 0 THEN ['handoff_to_human', 'execute_refund'] ELSE [] END AS must_not_call, k % 6 = 0 AS ordered, CASE WHEN k % 2 = 0 THEN 2 END AS max_searches, k % 7 IN (2, 3) AS must_include_receipt,
  CASE WHEN k % 3 = 0 THEN [] ELSE ['7 days', 'receipt'] END AS mention, CASE WHEN k % 10 = 0 THEN ['no number'] ELSE [] END AS not_mention, CASE WHEN k % 2 = 1 THEN ['P02', 'P07'] ELSE [] END AS prefer_docs,
  CASE WHEN k % 7 = 2 THEN '批准' WHEN k % 7 = 3 THEN '拒绝' END AS want_decision, 'O' || k AS want_order, CASE WHEN k % 7 = 2 THEN price ELSE 0 END AS want_amount FROM e_orders WHERE pos <= 3),
e_cases AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 4 = 0 THEN 'P0' ELSE 'P1' END AS priority, CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END AS run_error,
  CASE WHEN c_custkey % 9 = 0 THEN 1 + c_custkey % 2 END AS replay_rows, CASE WHEN c_custkey % 5 = 0 THEN ['R1', 'R2'] ELSE ['R1', 'R1'] END AS replay_receipts, CASE WHEN c_custkey % 9 = 0 THEN 1 END AS expected_rows FROM customer)"""

def _texts(*names: str):
    return F.array(*map(F.lit, names)).cast("array<string>")


def _by(number, choices: dict, otherwise):
    out = otherwise
    for n, value in choices.items():
        out = F.when(number == n, value).otherwise(out)
    return out


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("case_id"), F.col("o_totalprice").cast("double").alias("price"), place.alias("pos"))


def turns_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was done: case_id, pos, k, tools, verdicts, policy, log, answer."""
    return turns_from(orders_of(spark, sf_dir))


def turns_from(o: DataFrame) -> DataFrame:
    """The turns of orders (k, price and more), batch or stream."""
    n, none = F.col("k") % 7, _texts()
    tools = _by(n, {
        0: none, 1: _texts("get_customer_info", "search_refund_policy"), 2: _texts("get_customer_info", "search_refund_policy", "check_refund_eligibility", "execute_refund"),
        3: _texts("get_customer_info", "check_refund_eligibility", "record_refund_denial"), 4: _texts("check_refund_eligibility", "handoff_to_human"),
        5: _texts("search_refund_policy", "search_refund_policy", "search_refund_policy", "check_refund_eligibility"),
    }, _texts("check_refund_eligibility", "execute_refund", "execute_refund"))
    said = _by(F.col("k") % 5, {0: _texts("通过：可退"), 1: _texts("参数错误：x", "不通过：超期"), 2: _texts("通过：a", "参数错误：b"), 3: _texts("需补充：缺")}, _texts("参数错误：y"))
    letter, order = F.when(n == 3, "D").otherwise("R"), F.concat(F.lit("O"), (F.col("k") + F.when(F.col("k") % 13 == 0, 1).otherwise(0)).cast("string"))
    amount = F.when(n == 3, 0.0).otherwise(F.col("price") + F.when(F.col("k") % 11 == 0, 1.0).otherwise(0.0))
    row = lambda add: F.struct(F.when(n == 3, "拒绝").otherwise("批准").alias("decision"), F.concat(letter, (F.col("k") + 9000 + add).cast("string")).alias("receipt"), order.alias("order_id"), amount.alias("amount"))
    log = F.when(n.isin(2, 3), F.array(row(0))).when(n == 6, F.array(row(0), row(1))).otherwise(F.array().cast("array<struct<decision:string,receipt:string,order_id:string,amount:double>>"))
    policy = F.when(n.isin(1, 2, 5), F.when(F.col("k") % 4 == 1, _texts("[E1] P02 text", "P 07 more")).otherwise(_texts("[E1] P02 text"))).otherwise(none)
    t = o.select("*", tools.alias("tools"), F.when(n < 2, none).otherwise(said).alias("verdicts"), policy.alias("policy"), log.alias("log"))
    last = F.try_element_at("log", F.lit(-1))["receipt"]
    spaced = F.concat(F.lit("the receipt "), F.substring(last, 1, 3), F.lit(" "), F.substring(last, 4, 40))
    answer = F.when(F.col("k") % 3 == 0, "no number here").when(F.col("k") % 3 == 2, "see D9999, refund within 7days").when(F.size("log") > 0, spaced).otherwise("wait 7 days")
    return t.withColumn("answer", answer)


def expectations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was expected of the first three turns of each case."""
    o, n, none = orders_of(spark, sf_dir).filter("pos <= 3"), F.col("k") % 7, _texts()
    natural = _by(n, {0: F.lit("ask_order_id"), 2: F.lit("approved"), 3: F.lit("denied"), 4: F.lit("handoff"), 6: F.lit("approved")}, F.lit("clarify"))
    want = F.struct(F.when(n == 2, "批准").otherwise("拒绝").alias("decision"), F.concat(F.lit("O"), F.col("k").cast("string")).alias("order_id"), F.when(n == 2, F.col("price")).otherwise(0.0).alias("amount"))
    return o.select(
        "case_id", "pos", F.when(F.col("k") % 4 == 0, "denied").otherwise(natural).alias("expected_outcome"),
        F.when(n == 2, _texts("execute_refund")).when(n == 3, _texts("record_refund_denial")).when(F.col("k") % 2 == 0, _texts("search_refund_policy")).otherwise(none).alias("must_call"),
        F.when(F.col("k") % 5 == 0, _texts("handoff_to_human", "execute_refund")).otherwise(none).alias("must_not_call"),
        F.when(F.col("k") % 6 == 0, _texts("get_customer_info", "check_refund_eligibility")).otherwise(none).alias("call_order"),
        F.when(F.col("k") % 2 == 0, 2).alias("max_searches"), n.isin(2, 3).alias("must_include_receipt"), F.when(n.isin(2, 3), want).alias("expected_log"),
        F.when(F.col("k") % 3 == 0, none).otherwise(_texts("7 days", "receipt")).alias("mention"), F.when(F.col("k") % 10 == 0, _texts("no number")).otherwise(none).alias("not_mention"),
        F.when(F.col("k") % 2 == 1, _texts("P02", "P07")).otherwise(none).alias("prefer_docs"),
    )


def cases_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, priority, run_error, and what running every ninth case again gave."""
    c, again = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")), F.col("case_id") % 9 == 0
    return c.select(
        "case_id", F.when(F.col("case_id") % 4 == 0, "P0").otherwise("P1").alias("priority"), F.when(F.col("case_id") % 23 == 0, 1).otherwise(0).alias("run_error"),
        F.when(again, 1 + F.col("case_id") % 2).alias("replay_rows"), F.when(F.col("case_id") % 5 == 0, _texts("R1", "R2")).otherwise(_texts("R1", "R1")).alias("replay_receipts"),
        F.when(again, 1).alias("expected_rows"), F.lit(True).alias("same_receipt"),
    )

"""Queries over requests, verdicts and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistra.operators import decision
from evistra.registry import query
from evistra.sources.facades import ORDERS_SQL, TURNS_SQL, acts_view, customers_view, load, orders_view, requests_view

_VERDICTS_SQL = f"""
WITH {ORDERS_SQL},
ruled AS (
  SELECT r.order_id, r.acting_user, o.price,
    CASE WHEN o.customer_id IS NULL THEN 1 WHEN o.refunded THEN 2 WHEN c.refund_count > 3 THEN 3 WHEN o.category = 'PROMO' THEN 4
         WHEN o.days > 15 THEN 5 WHEN r.reason = '' THEN 6 WHEN r.reason <> 'quality' AND r.condition = '' THEN 7
         WHEN o.days > (CASE WHEN r.reason = 'quality' OR c.gold THEN 15 ELSE 7 END) THEN 8
         WHEN r.reason <> 'quality' AND r.condition <> 'unopened' THEN 9 ELSE 10 END AS rule_no
  FROM v_requests r LEFT JOIN v_orders o ON r.order_id = o.order_id AND r.acting_user = o.customer_id
  LEFT JOIN v_customers c ON o.customer_id = c.customer_id),
verdicts AS (
  SELECT order_id, acting_user, rule_no, CASE WHEN rule_no = 10 THEN 'approve' WHEN rule_no IN (6, 7) THEN 'need_info' ELSE 'deny' END AS verdict,
         CASE WHEN rule_no = 10 THEN price ELSE 0 END AS refundable FROM ruled)
"""


@query("K1 C1", _VERDICTS_SQL + "SELECT * FROM verdicts")
def eligibility_verdicts(spark, sf_dir):
    return decision.eligibility(requests_view(spark, sf_dir), orders_view(spark, sf_dir), customers_view(spark, sf_dir))


@query("K1 D-26", _VERDICTS_SQL + "SELECT verdict, rule_no, count(*) AS n, round(sum(refundable), 2) AS refundable FROM verdicts GROUP BY 1, 2")
def eligibility_rollup(spark, sf_dir):
    v = eligibility_verdicts(spark, sf_dir)
    return v.groupBy("verdict", "rule_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("refundable"), 2).alias("refundable"))


@query("D-26 D-25", _VERDICTS_SQL + "SELECT verdict AS outcome, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM verdicts GROUP BY 1")
def outcome_distribution(spark, sf_dir):
    n = eligibility_verdicts(spark, sf_dir).groupBy(F.col("verdict").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("outcome", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("C2 F12", f"""WITH {ORDERS_SQL}
SELECT c.customer_id, gold, refund_count, count(order_id) AS n_orders, coalesce(string_agg(CAST(order_id AS VARCHAR), ',' ORDER BY order_id), '') AS orders
FROM v_customers c LEFT JOIN v_orders o ON c.customer_id = o.customer_id GROUP BY 1, 2, 3""")
def customer_profiles(spark, sf_dir):
    o = orders_view(spark, sf_dir).groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("order_id", "category", "price", "days", "refunded"))).alias("list"))
    c = customers_view(spark, sf_dir).join(o, "customer_id", "left")
    ids = F.transform(F.coalesce("list", F.array().cast(o.schema["list"].dataType)), lambda x: x["order_id"].cast("string"))
    return c.select("customer_id", "gold", "refund_count", F.size(ids).cast("long").alias("n_orders"), F.array_join(ids, ",").alias("orders"))


_ATTEMPTS_SQL = f"""WITH {TURNS_SQL},
attempts AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'k' || (event_id % 11) END AS key,
  CASE WHEN tool = 'execute_refund' THEN 'approve' ELSE 'deny' END AS action FROM acts WHERE tool IN ('execute_refund', 'record_denial')),
first AS (SELECT *, min(seq) OVER (PARTITION BY session, CASE WHEN key = '' THEN 'seq' || seq ELSE key END) AS first_seq FROM attempts)
"""


def _attempts(spark, sf_dir):
    a = acts_view(spark, sf_dir).filter(F.col("tool").isin("execute_refund", "record_denial"))
    key = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("k"), (F.col("event_id") % 11).cast("string")))
    return a.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), key.alias("key"), F.when(F.col("tool") == "execute_refund", "approve").otherwise("deny").alias("action"))


@query("K4 C16 ST3", _ATTEMPTS_SQL + "SELECT session, seq, key, action, first_seq, first_seq <> seq AS replayed FROM first")
def ledger_replay(spark, sf_dir):
    return decision.replay(_attempts(spark, sf_dir))


@query("H15 A7 A23", _ATTEMPTS_SQL + """SELECT session, seq, action,
  CASE WHEN action = 'approve' THEN 'R' ELSE 'D' END || (9000 + row_number() OVER (PARTITION BY session ORDER BY seq) - 1) AS receipt FROM first WHERE first_seq = seq""")
def ledger_receipts(spark, sf_dir):
    return decision.receipts(_attempts(spark, sf_dir)).select("session", "seq", "action", "receipt")


@query("A24", f"""{_VERDICTS_SQL} SELECT o.order_id, o.refunded OR coalesce(bool_or(v.verdict = 'approve'), false) AS refunded
FROM v_orders o LEFT JOIN verdicts v ON o.order_id = v.order_id GROUP BY o.order_id, o.refunded""")
def refund_overlay(spark, sf_dir):
    o, v = orders_view(spark, sf_dir), eligibility_verdicts(spark, sf_dir)
    approved = v.filter("verdict = 'approve'").select("order_id").distinct().withColumn("hit", F.lit(True))
    return o.join(approved, "order_id", "left").select("order_id", (F.col("refunded") | F.coalesce("hit", F.lit(False))).alias("refunded"))


@query("I9", "SELECT c_custkey, substr(sha256('salt:' || c_custkey), 1, 16) AS masked_id FROM customer")
def customer_hash(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.substring(F.sha2(F.concat(F.lit("salt:"), F.col("c_custkey").cast("string")), 256), 1, 16).alias("masked_id"))


@query("A15 G6", """WITH old AS (SELECT c_custkey AS id, c_mktsegment AS body, 0 AS version FROM customer WHERE c_custkey % 2 = 0),
new AS (SELECT c_custkey // 2 AS id, c_name AS body, c_custkey AS version FROM customer),
last AS (SELECT id, body, version FROM new QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)
SELECT * FROM last UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM last)""")
def keyed_upsert(spark, sf_dir):
    from evistra.sources.readers import upsert

    c = load(spark, sf_dir, "customer")
    old = c.filter(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("body"), F.lit(0).cast("long").alias("version"))
    new = c.select(F.expr("c_custkey div 2").alias("id"), F.col("c_name").alias("body"), F.col("c_custkey").alias("version"))
    return upsert(old, new, "id")


_SETTLED_SQL = f"""WITH RECURSIVE {ORDERS_SQL}, {TURNS_SQL},
ends AS (SELECT customer_id, min(order_id) AS low, max(order_id) AS high FROM v_orders GROUP BY 1),
tries AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'k' || (event_id % 11) END AS key, CASE WHEN tool = 'execute_refund' THEN 'approve' ELSE 'deny' END AS action,
  CASE WHEN event_id % 4 = 0 THEN high ELSE low END AS order_id, user_id + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS acting_user
  FROM acts LEFT JOIN ends ON user_id = customer_id WHERE tool IN ('execute_refund', 'record_denial')),
numbered AS (SELECT t.*, o.price, o.customer_id, o.refunded AS was, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM tries t LEFT JOIN v_orders o ON t.order_id = o.order_id),
walk AS (SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS action, CAST(NULL AS BIGINT) AS order_id, '' AS status, CAST(NULL AS VARCHAR) AS receipt, CAST(NULL AS DOUBLE) AS amount,
    CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS receipts, CAST([] AS DOUBLE[]) AS amounts, CAST([] AS BIGINT[]) AS paid, 9000 AS next FROM numbered
  UNION ALL SELECT session, n, seq, action, order_id, status, CASE status WHEN 'replayed' THEN receipts[held] WHEN 'applied' THEN fresh END, CASE status WHEN 'replayed' THEN amounts[held] WHEN 'applied' THEN give END,
    CASE WHEN status = 'applied' AND key <> '' THEN list_append(keys, key) ELSE keys END, CASE WHEN status = 'applied' AND key <> '' THEN list_append(receipts, fresh) ELSE receipts END,
    CASE WHEN status = 'applied' AND key <> '' THEN list_append(amounts, give) ELSE amounts END, CASE WHEN status = 'applied' AND action = 'approve' THEN list_append(paid, order_id) ELSE paid END,
    next + CASE WHEN status = 'applied' THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN held > 0 THEN 'replayed' WHEN action = 'deny' THEN 'applied' WHEN customer_id IS NULL OR customer_id <> acting_user THEN 'missing' WHEN was OR list_contains(paid, order_id) THEN 'refunded' ELSE 'applied' END AS status
    FROM (SELECT w.keys, w.receipts, w.amounts, w.paid, w.next, a.session, a.n, a.seq, a.key, a.action, a.order_id, a.acting_user, a.customer_id, a.was, CASE WHEN a.key = '' THEN 0 ELSE coalesce(list_position(w.keys, a.key), 0) END AS held,
      CASE WHEN a.action = 'approve' THEN 'R' ELSE 'D' END || w.next AS fresh, CASE WHEN a.action = 'approve' THEN a.price ELSE 0 END AS give FROM walk w JOIN numbered a ON a.session = w.session AND a.n = w.n + 1))),
settled AS (SELECT session, seq, action, order_id, status, receipt, amount FROM walk WHERE n > 0)
"""


def _settled(spark, sf_dir):
    o = orders_view(spark, sf_dir)
    ends = o.groupBy(F.col("customer_id").alias("session")).agg(F.min("order_id").alias("low"), F.max("order_id").alias("high"))
    tries = _attempts(spark, sf_dir).join(ends, "session", "left").withColumn("order_id", F.when(F.col("seq") % 4 == 0, F.col("high")).otherwise(F.col("low")))
    tries = tries.join(o.select("order_id", F.col("price").cast("double").alias("amount")), "order_id", "left")
    return decision.settle(tries.withColumn("acting_user", F.col("session") + F.when(F.col("seq") % 9 == 0, 1).otherwise(0)), o)


@query("K2 K3 A23", _SETTLED_SQL + "SELECT * FROM settled")
def ledger_settled(spark, sf_dir):
    return _settled(spark, sf_dir)


@query("A24 A25 ST4", _SETTLED_SQL + """, paid AS (SELECT DISTINCT session, order_id FROM settled WHERE status = 'applied' AND action = 'approve')
SELECT coalesce(p.session, o.customer_id) AS session, o.order_id, o.refunded OR p.order_id IS NOT NULL AS refunded FROM v_orders o LEFT JOIN paid p ON o.order_id = p.order_id""")
def orders_after_session(spark, sf_dir):
    """Each session's own state of the orders: the table as it was, and over it what the session's ledger changed."""
    o, s = orders_view(spark, sf_dir), _settled(spark, sf_dir)
    paid = s.filter("status = 'applied' and action = 'approve'").select("order_id", "session").distinct()
    return o.join(paid, "order_id", "left").select(F.coalesce("session", "customer_id").alias("session"), "order_id", (F.col("refunded") | F.col("session").isNotNull()).alias("refunded"))


@query("B8", """SELECT o_orderkey, CASE WHEN reason NOT IN ('quality', 'no_reason', '') THEN '参数错误：reason_type ' || reason WHEN condition NOT IN ('unopened', 'opened', 'used', '') THEN '参数错误：item_condition ' || condition ELSE '' END AS arg_error
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'quality' WHEN 1 THEN '' ELSE 'bored' || o_orderkey % 5 END AS reason, CASE o_orderkey % 4 WHEN 0 THEN 'broken' WHEN 1 THEN 'opened' ELSE '' END AS condition FROM orders)""")
def argument_errors(spark, sf_dir):
    """A tool's arguments outside their lists give a message in place of an error; the first wrong one is told."""
    k = F.col("o_orderkey")
    a = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "quality").when(k % 3 == 1, "").otherwise(F.concat(F.lit("bored"), (k % 5).cast("string"))).alias("reason_type"),
        F.when(k % 4 == 0, "broken").when(k % 4 == 1, "opened").otherwise("").alias("item_condition"),
    )
    return a.select("o_orderkey", decision.argument_error({"reason_type": decision.REASONS, "item_condition": decision.CONDITIONS}).alias("arg_error"))

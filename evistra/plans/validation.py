"""Integrity checks over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evistra.functions import text as X
from evistra.operators import checks
from evistra.operators.checks import dangling, duplicates, union_all, violations
from evistra.plans.decisions import _VERDICTS_SQL, eligibility_verdicts
from evistra.registry import query
from evistra.sources.evals import orders_of
from evistra.sources.facades import load


@query("N12 N14", """SELECT CAST(o_orderkey AS VARCHAR) AS key, 'price' AS rule FROM orders WHERE NOT coalesce(o_totalprice > 1000, false)
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'status' FROM orders WHERE NOT coalesce(o_orderstatus IN ('F', 'O'), false)
UNION ALL SELECT CAST(vec_id AS VARCHAR), 'dimension' FROM embeddings WHERE len(embedding) <> 64""")
def constraint_violations(spark, sf_dir):
    o = violations(load(spark, sf_dir, "orders"), "o_orderkey", {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")})
    return o.union(violations(load(spark, sf_dir, "embeddings"), "vec_id", {"dimension": F.size("embedding") == 64}))


_REFS_SQL = """WITH o AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_custkey ELSE o_custkey END AS k FROM orders), e AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN user_id + 100000000 ELSE user_id END AS k FROM events),
l AS (SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id + 100000000 ELSE doc_id END AS k FROM labels)
"""


@query("C12 C13", _REFS_SQL + """SELECT 'orders' AS child, CAST(k AS VARCHAR) AS key, count(*) AS n FROM o WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'events', CAST(k AS VARCHAR), count(*) FROM e WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY 2
UNION ALL SELECT 'labels', CAST(k AS VARCHAR), count(*) FROM l WHERE k NOT IN (SELECT doc_id FROM documents) GROUP BY 2""")
def dangling_refs(spark, sf_dir):
    """References to nothing, with how many rows make them: some of the orders', events' and labels' keys are broken here.
    A null refers to nothing and breaks no rule."""
    k = lambda n, c: load(spark, sf_dir, n).select(c.alias("k"))
    orders = k("orders", F.when(F.col("o_orderkey") % 50 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")))
    events = k("events", F.when(F.col("event_id") % 97 == 0, None).when(F.col("event_id") % 89 == 0, F.col("user_id") + 100000000).otherwise(F.col("user_id")))
    labels = k("labels", F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") + 100000000).otherwise(F.col("doc_id")))
    one = lambda child, rows, target, key: dangling(rows.filter("k is not null"), "k", load(spark, sf_dir, target), key).withColumn("child", F.lit(child))
    return union_all([one("orders", orders, "customer", "c_custkey"), one("events", events, "customer", "c_custkey"), one("labels", labels, "documents", "doc_id")])


@query("G6", "SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return duplicates(load(spark, sf_dir, "documents").select(F.md5("text").alias("digest")), "digest")


@query("G6", "SELECT doc_id, lag(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS holder FROM documents QUALIFY holder IS NOT NULL")
def previous_holder(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"))
    return d.select("doc_id", F.lag("doc_id").over(Window.partitionBy("m").orderBy("doc_id")).alias("holder")).filter("holder is not null")


@query("I10 G3", """WITH a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')) AS said FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?')))) AS given FROM conversations WHERE role <> 'assistant' GROUP BY 1)
SELECT a.conv_id, a.turn, len(list_filter(said, lambda x: NOT list_contains(coalesce(given, []), x))) AS unsupported FROM a LEFT JOIN u ON a.conv_id = u.conv_id""")
def number_provenance(spark, sf_dir):
    """Numbers an answer gives that nobody else of its conversation did."""
    c = load(spark, sf_dir, "conversations")
    said = c.filter("role = 'assistant'").select("conv_id", "turn", F.array_distinct(X.numbers(F.col("text"))).alias("said"))
    given = c.filter("role <> 'assistant'").select("conv_id", F.explode(X.numbers(F.col("text"))).alias("x")).distinct().groupBy("conv_id").agg(F.collect_set("x").alias("given"))
    left = F.size(F.array_except("said", F.coalesce("given", F.array().cast("array<string>"))))
    return said.join(given, "conv_id", "left").select("conv_id", "turn", left.cast("long").alias("unsupported"))


@query("D-24 G7", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2)
SELECT doc_id, count_if(n > 1) AS repeated, sum((n - 1) * length(line)) AS extra_chars FROM k GROUP BY 1""")
def duplicate_paragraphs(spark, sf_dir):
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    k = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum((F.col("n") - 1) * F.length("line")).alias("extra_chars"))


@query("G2", _VERDICTS_SQL + """, told AS (SELECT order_id, rule_no, CASE WHEN order_id % 71 = 0 AND verdict = 'approve' THEN 'deny' ELSE verdict END AS verdict, CASE WHEN order_id % 61 = 0 THEN 0 WHEN order_id % 67 = 0 THEN 5.0 ELSE refundable END AS refundable FROM verdicts)
SELECT order_id, CASE WHEN verdict = 'approve' AND refundable <= 0 THEN 'amount' WHEN verdict <> 'approve' AND refundable > 0 THEN 'denied amount' WHEN rule_no = 10 AND order_id % 1000 = 0 THEN 'probe' END AS problem FROM told
WHERE verdict = 'approve' AND refundable <= 0 OR verdict <> 'approve' AND refundable > 0 OR rule_no = 10 AND order_id % 1000 = 0""")
def verdict_consistency(spark, sf_dir):
    """Verdicts that contradict themselves; some are told wrong here: approved as denied, without or with an amount."""
    v, k = eligibility_verdicts(spark, sf_dir), F.col("order_id")
    told = F.when((k % 71 == 0) & (F.col("verdict") == "approve"), "deny").otherwise(F.col("verdict"))
    v = v.withColumns({"verdict": told, "refundable": F.when(k % 61 == 0, 0.0).when(k % 67 == 0, 5.0).otherwise(F.col("refundable").cast("double"))})
    rules = [
        F.when((F.col("verdict") == "approve") & (F.col("refundable") <= 0), "amount"), F.when((F.col("verdict") != "approve") & (F.col("refundable") > 0), "denied amount"),
        F.when((F.col("rule_no") == 10) & (F.col("order_id") % 1000 == 0), "probe"),
    ]
    return v.select("order_id", F.coalesce(*rules).alias("problem")).filter("problem is not null")


@query("B9", "SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, 'The')), chr(10)) AS kept FROM conversations")
def line_filter(spark, sf_dir):
    keep = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.startswith("The")), "\n")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", keep.alias("kept"))


# --- evaluation cases, some of which are wrong on purpose --------------------------------------------------------------

_RULED_SQL = _VERDICTS_SQL + """, ruled2 AS (SELECT o_orderkey AS k, o_custkey AS u, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, rule_no, verdict, refundable,
  CASE verdict WHEN 'approve' THEN '通过' WHEN 'deny' THEN '不通过' ELSE '需补充' END AS said FROM orders JOIN verdicts ON o_orderkey = verdicts.order_id),
made AS (SELECT *, CASE WHEN k % 29 = 0 THEN 'unsure' WHEN k % 7 = 0 THEN 'ask_order_id' WHEN verdict = 'approve' THEN 'approved' WHEN verdict = 'deny' THEN 'denied' ELSE 'clarify' END AS outcome FROM ruled2),
wanted AS (SELECT *, NOT (k % 7 = 0 OR k % 31 = 0) AS anchored, CASE WHEN k % 17 = 0 THEN '通过' ELSE said END AS anchor_verdict, refundable + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS anchor_amount,
  CASE WHEN k % 13 = 0 THEN 'rule 99' ELSE 'rule' END AS fragment, CASE WHEN k % 23 = 0 THEN 'O0' ELSE 'O' || k END AS log_order,
  CASE WHEN k % 11 = 0 THEN NULL WHEN outcome = 'approved' THEN '批准' WHEN outcome = 'denied' THEN CASE WHEN k % 37 = 0 THEN '批准' ELSE '拒绝' END WHEN k % 5 = 0 THEN '拒绝' END AS log_decision,
  CASE WHEN outcome = 'approved' THEN refundable WHEN k % 41 = 0 THEN 5 ELSE 0 END AS log_amount,
  CASE outcome WHEN 'approved' THEN CASE WHEN k % 10 = 0 THEN [] ELSE ['execute_refund'] END WHEN 'denied' THEN ['record_refund_denial'] ELSE CASE WHEN k % 4 = 0 THEN ['execute_refund'] ELSE [] END END AS must,
  CASE outcome WHEN 'approved' THEN ['record_refund_denial'] WHEN 'denied' THEN CASE WHEN k % 9 = 0 THEN ['record_refund_denial'] ELSE ['execute_refund'] END ELSE CASE WHEN k % 6 = 0 THEN ['execute_refund'] ELSE ['execute_refund', 'record_refund_denial'] END END AS forbid,
  CASE WHEN k % 8 = 0 THEN ['get_customer_info'] ELSE [] END AS call_order, outcome IN ('approved', 'denied') <> (k % 21 = 0) AS receipt_flag, CASE WHEN k % 15 = 0 THEN ['x', 'y'] ELSE ['x'] END AS mention, ['y'] AS not_mention FROM made),
spec AS (SELECT *, CASE outcome WHEN 'approved' THEN '通过' WHEN 'denied' THEN '不通过' WHEN 'clarify' THEN '需补充' END AS want_verdict, CASE outcome WHEN 'approved' THEN '批准' WHEN 'denied' THEN '拒绝' END AS want_decision FROM wanted),
errors AS (SELECT u AS case_id, pos, unnest(CASE WHEN outcome = 'unsure' THEN ['unknown outcome'] ELSE list_filter([
  CASE WHEN want_verdict IS NOT NULL AND NOT anchored THEN 'anchor missing' END, CASE WHEN anchored AND said <> anchor_verdict THEN 'verdict differs' END,
  CASE WHEN anchored AND NOT contains('rule ' || rule_no, fragment) THEN 'reason lacks a fragment' END, CASE WHEN anchored AND abs(refundable - anchor_amount) > 1e-6 THEN 'amount differs' END,
  CASE WHEN anchored AND anchor_verdict <> want_verdict THEN 'outcome against verdict' END, CASE WHEN want_decision IS NOT NULL AND log_decision IS NULL THEN 'log missing' END,
  CASE WHEN log_decision <> want_decision THEN 'log direction' END, CASE WHEN log_decision IS NOT NULL AND want_decision IS NOT NULL AND anchored AND log_order <> 'O' || k THEN 'log order' END,
  CASE WHEN log_decision IS NOT NULL AND outcome = 'approved' AND anchored AND abs(log_amount - anchor_amount) > 1e-6 THEN 'approved amount' END, CASE WHEN log_decision IS NOT NULL AND outcome = 'denied' AND abs(log_amount) > 1e-6 THEN 'denied amount' END,
  CASE WHEN log_decision IS NOT NULL AND want_decision IS NULL THEN 'log unwanted' END,
  CASE WHEN outcome = 'approved' AND NOT list_contains(must, 'execute_refund') OR outcome = 'denied' AND NOT list_contains(must, 'record_refund_denial') THEN 'must lacks tool' END,
  CASE WHEN outcome = 'approved' AND NOT list_contains(forbid, 'record_refund_denial') OR outcome = 'denied' AND NOT list_contains(forbid, 'execute_refund') THEN 'forbid lacks tool' END,
  CASE WHEN want_decision IS NULL AND list_has_any(must, ['execute_refund', 'record_refund_denial']) THEN 'final tool wanted' END, CASE WHEN want_decision IS NULL AND NOT list_has_all(forbid, ['execute_refund', 'record_refund_denial']) THEN 'final tool allowed' END,
  CASE WHEN list_has_any(must, forbid) THEN 'tools overlap' END, CASE WHEN NOT list_has_all(must, call_order) THEN 'order beyond must' END, CASE WHEN receipt_flag <> (want_decision IS NOT NULL) THEN 'receipt flag' END,
  CASE WHEN list_has_any(mention, not_mention) THEN 'mentions overlap' END], lambda x: x IS NOT NULL) END) AS error FROM spec)
"""


def _expected_turns(spark, sf_dir):
    """Expectations of a turn an order, anchored in what the rules say of its request; keys with certain divisors are wrong."""
    k, o = F.col("k"), F.col("outcome")
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    each = lambda n: k % n == 0
    v = eligibility_verdicts(spark, sf_dir).withColumnRenamed("order_id", "k").withColumn("said", F.when(F.col("verdict") == "approve", "通过").when(F.col("verdict") == "deny", "不通过").otherwise("需补充"))
    t = orders_of(spark, sf_dir).join(v, "k").withColumn("amount", F.col("refundable").cast("double"))
    natural = F.when(F.col("verdict") == "approve", "approved").when(F.col("verdict") == "deny", "denied").otherwise("clarify")
    t = t.withColumn("outcome", F.when(each(29), "unsure").when(each(7), "ask_order_id").otherwise(natural))
    order = F.concat(F.lit("O"), k.cast("string"))
    anchor = F.struct(
        F.when(each(17), "通过").otherwise(F.col("said")).alias("verdict"), (F.col("amount") + F.when(each(19), 1.0).otherwise(0.0)).alias("amount"),
        F.array(F.when(each(13), "rule 99").otherwise("rule")).alias("fragments"), order.alias("order_id"),
    )
    decision = F.when(o == "approved", "批准").when((o == "denied") & each(37), "批准").when(o == "denied", "拒绝").when(each(5), "拒绝")
    log = F.struct(decision.alias("decision"), F.when(each(23), "O0").otherwise(order).alias("order_id"), F.when(o == "approved", F.col("amount")).when(each(41), 5.0).otherwise(0.0).alias("amount"))
    must = F.when((o == "approved") & each(10), texts()).when(o == "approved", texts("execute_refund")).when(o == "denied", texts("record_refund_denial")).when(each(4), texts("execute_refund")).otherwise(texts())
    forbid = F.when((o == "approved") | ((o == "denied") & each(9)), texts("record_refund_denial")).when((o == "denied") | each(6), texts("execute_refund")).otherwise(texts("execute_refund", "record_refund_denial"))
    return t.select(
        "case_id", "pos", "outcome", F.when(~(each(7) | each(31)), anchor).alias("anchor"), F.struct(F.col("said").alias("verdict"), "amount", F.format_string("rule %d", "rule_no").alias("reason")).alias("rule"),
        F.when(~each(11) & decision.isNotNull(), log).alias("log"), must.alias("must_call"), forbid.alias("must_not_call"), F.when(each(8), texts("get_customer_info")).otherwise(texts()).alias("call_order"),
        (o.isin("approved", "denied") != each(21)).alias("must_include_receipt"), F.when(each(15), texts("x", "y")).otherwise(texts("x")).alias("mention"), texts("y").alias("not_mention"),
    )


@query("N6 N7 N8 N9 N10 G2", _RULED_SQL + "SELECT case_id, pos, error FROM errors")
def expectation_errors(spark, sf_dir):
    return checks.expectation_errors(_expected_turns(spark, sf_dir))


@query("N11 N2 C13", """WITH c AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 25 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS case_id, 'r' || CASE WHEN o_orderkey % 20 = 0 THEN o_custkey ELSE 1000000 + o_orderkey END AS request_id,
    CASE WHEN o_orderkey % 50 = 1 THEN 'prod' WHEN o_orderkey % 50 = 2 THEN NULL ELSE 'eval' END AS source, o_custkey + CASE WHEN o_orderkey % 40 = 3 THEN 10000000 ELSE 0 END AS customer_id, o_orderkey % 35 AS n_turns FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY line) > 1 AS again, lag(case_id) OVER (PARTITION BY request_id ORDER BY line) AS holder FROM c)
SELECT case_id, line, 'case repeated' AS error, NULL AS other FROM w WHERE again UNION ALL SELECT case_id, line, 'request repeated', holder FROM w WHERE holder IS NOT NULL
UNION ALL SELECT case_id, line, 'source', NULL FROM w WHERE coalesce(source, '') <> 'eval' UNION ALL SELECT case_id, line, 'no turns', NULL FROM w WHERE n_turns = 0
UNION ALL SELECT case_id, line, 'customer unknown', NULL FROM w WHERE customer_id NOT IN (SELECT c_custkey FROM customer)""")
def case_errors(spark, sf_dir):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    request = F.when(k % 20 == 0, u).otherwise(k + 1000000)
    c = load(spark, sf_dir, "orders").select(
        k.alias("line"), F.when(k % 25 == 0, k - 1).otherwise(k).alias("case_id"), F.concat(F.lit("r"), request.cast("string")).alias("request_id"), F.when(k % 50 == 1, "prod").when(k % 50 != 2, "eval").alias("source"),
        (u + F.when(k % 40 == 3, 10000000).otherwise(0)).alias("customer_id"), (k % 35).alias("n_turns"),
    )
    return checks.case_errors(c, load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id")))


_R1_SQL = """WITH bodies AS (SELECT doc_id AS chunk_id, text AS body FROM documents), made AS (SELECT item_id AS line, CASE WHEN item_id % 12 = 0 THEN item_id - 1 ELSE item_id END AS case_id,
    CASE WHEN item_id % 10 = 0 THEN 'the same question ' ELSE 'question ' || item_id END AS question, CASE WHEN item_id % 11 = 0 THEN '' WHEN item_id % 4 = 0 THEN '可以退。within 7 days of the order' WHEN item_id % 4 = 1 THEN '可以在七天之内退的。no' ELSE 'after ' || (item_id * 7) || ' or 2.50 days' END AS ground_truth,
    CASE WHEN item_id % 9 = 0 THEN [] WHEN item_id % 7 = 0 THEN [item_id, 900000000 + item_id] ELSE [item_id * 2, item_id * 2 + 1] END AS source FROM benchmark),
whole AS (SELECT *, lag(case_id) OVER (PARTITION BY trim(question) ORDER BY line) AS holder, row_number() OVER (PARTITION BY case_id ORDER BY line) > 1 AS again FROM made WHERE ground_truth <> '' AND len(source) > 0),
ids AS (SELECT line, unnest(source) AS chunk_id FROM whole), known AS (SELECT line, list(ids.chunk_id ORDER BY ids.chunk_id) FILTER (b.chunk_id IS NULL) AS gone, list_distinct(flatten(list(regexp_extract_all(body, '[0-9]+(?:\\.[0-9]+)?')))) AS numbers FROM ids LEFT JOIN bodies b ON ids.chunk_id = b.chunk_id GROUP BY 1),
all_ AS (SELECT whole.*, coalesce(gone, []) AS gone, list_filter(list_sort(list_distinct(regexp_extract_all(ground_truth, '[0-9]+(?:\\.[0-9]+)?'))), lambda x: NOT list_contains(coalesce(numbers, []), x)) AS invented FROM whole JOIN known ON whole.line = known.line)
SELECT line, case_id, 'fields' AS error, concat_ws(',', CASE WHEN ground_truth = '' THEN 'ground_truth' END, CASE WHEN len(source) = 0 THEN 'source' END) AS detail FROM made WHERE ground_truth = '' OR len(source) = 0
UNION ALL SELECT line, case_id, 'case repeated', '' FROM all_ WHERE again UNION ALL SELECT line, case_id, 'question repeated', CAST(holder AS VARCHAR) FROM all_ WHERE holder IS NOT NULL
UNION ALL SELECT line, case_id, 'short lead', '可以退。' FROM all_ WHERE line % 4 = 0 UNION ALL SELECT line, case_id, 'unknown source', array_to_string(gone, ',') FROM all_ WHERE len(gone) > 0
UNION ALL SELECT line, case_id, 'invented number', array_to_string(invented, ',') FROM all_ WHERE len(gone) = 0 AND len(invented) > 0"""


@query("N1 N2 N3 N4 N5 C12", _R1_SQL)
def retrieval_case_errors(spark, sf_dir):
    k = F.col("item_id")
    ids = lambda *x: F.array(*x).cast("array<bigint>")
    truth = F.when(k % 11 == 0, "").when(k % 4 == 0, "可以退。within 7 days of the order").when(k % 4 == 1, "可以在七天之内退的。no").otherwise(F.concat(F.lit("after "), (k * 7).cast("string"), F.lit(" or 2.50 days")))
    c = load(spark, sf_dir, "benchmark").select(
        k.alias("line"), F.when(k % 12 == 0, k - 1).otherwise(k).alias("case_id"), F.when(k % 10 == 0, "the same question ").otherwise(F.concat(F.lit("question "), k.cast("string"))).alias("question"),
        truth.alias("ground_truth"), F.when(k % 9 == 0, ids()).when(k % 7 == 0, ids(k, k + 900000000)).otherwise(ids(k * 2, k * 2 + 1)).alias("source"),
    )
    return checks.retrieval_case_errors(c, load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body")))


@query("L2 N13", "SELECT count(*) AS chunks, count_if(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 1024) AS truncated, CASE WHEN count_if(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) > 1024) = 0 THEN 'ok' ELSE 'truncated' END AS gate FROM documents")
def truncation_gate(spark, sf_dir):
    """Whether all texts fit the encoder; a load that asks for it stops on anything but ok."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    t = load(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(n > 1024).alias("truncated"))
    return t.withColumn("gate", F.when(F.col("truncated") == 0, "ok").otherwise("truncated"))

"""Turns of traces, and what is watched of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evistra.functions import text
from evistra.operators import spans as S
from evistra.operators.stats import nearest_rank
from evistra.registry import query
from evistra.sources.facades import TURNS_SQL, acts_view, load
from evistra.sources.shared import kept

_TURN_SQL = f"""WITH {TURNS_SQL},
turns AS (SELECT user_id, day, list(tool ORDER BY ts, event_id) AS tools, count(*) AS n, count_if(tool IN ('execute_refund', 'record_denial')) AS n_ledger FROM acts GROUP BY 1, 2)
"""


def turns(spark, sf_dir):
    """A user's day: its tools in order, and how many ledger rows they left."""
    calls = F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool")))
    t = acts_view(spark, sf_dir).groupBy("user_id", "day").agg(F.transform(calls, lambda x: x["tool"]).alias("tools"))
    terminal = F.size(F.filter("tools", lambda x: x.isin("execute_refund", "record_denial")))
    return t.withColumn("n", F.size("tools").cast("long")).withColumn("n_ledger", terminal.cast("long"))


@query("L8", _TURN_SQL + "SELECT user_id, day, array_to_string(tools, '>') AS tools, n, n_ledger, list_last(list_filter(tools, lambda x: x IN ('execute_refund', 'record_denial'))) AS last_action FROM turns")
def turn_observe(spark, sf_dir):
    last = F.try_element_at(F.filter("tools", lambda x: x.isin("execute_refund", "record_denial")), F.lit(-1))
    return turns(spark, sf_dir).select("user_id", "day", F.array_join("tools", ">").alias("tools"), "n", "n_ledger", last.alias("last_action"))


@query("K6", _TURN_SQL + """SELECT user_id, day, CASE WHEN list_contains(tools, 'handoff') THEN 'handoff'
  WHEN n_ledger > 0 THEN CASE list_last(list_filter(tools, lambda x: x IN ('execute_refund', 'record_denial'))) WHEN 'execute_refund' THEN 'approved' ELSE 'denied' END
  WHEN n = 0 THEN 'ask_order_id' ELSE 'clarify' END AS outcome FROM turns""")
def turn_outcome(spark, sf_dir):
    last = F.try_element_at(F.filter("tools", lambda x: x.isin("execute_refund", "record_denial")), F.lit(-1))
    o = F.when(F.array_contains("tools", "handoff"), "handoff").when(F.col("n_ledger") > 0, F.when(last == "execute_refund", "approved").otherwise("denied"))
    return turns(spark, sf_dir).select("user_id", "day", o.when(F.col("n") == 0, "ask_order_id").otherwise("clarify").alias("outcome"))


@query("L8", _TURN_SQL + """SELECT user_id, day, CASE WHEN n_ledger <= 1 THEN 1 ELSE 0 END AS log_structure,
  CASE WHEN n_ledger = 0 OR list_contains(tools, 'check_eligibility') THEN 1 ELSE 0 END AS rule_consistency FROM turns""")
def online_scores(spark, sf_dir):
    return turns(spark, sf_dir).select("user_id", "day", (F.col("n_ledger") <= 1).cast("int").alias("log_structure"), ((F.col("n_ledger") == 0) | F.array_contains("tools", "check_eligibility")).cast("int").alias("rule_consistency"))


@query("H12 I20", _TURN_SQL + """SELECT user_id, day, regexp_matches(array_to_string(tools, '>'), 'get_profile.*search_policy') AS in_order,
  len(list_filter(tools, lambda x: x = 'search_policy')) <= 2 AS economical FROM turns""")
def tool_subsequence(spark, sf_dir):
    want = F.array(F.lit("get_profile"), F.lit("search_policy"))
    at = F.aggregate("tools", F.lit(0), lambda p, e: p + F.coalesce(F.get(want, p) == e, F.lit(False)).cast("int"))
    return turns(spark, sf_dir).select("user_id", "day", (at == 2).alias("in_order"), (F.size(F.filter("tools", lambda x: x == "search_policy")) <= 2).alias("economical"))


@query("C11", _TURN_SQL + """, actual AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY day) AS pos FROM turns),
expected AS (SELECT c_custkey AS user_id, unnest(range(1, 4)) AS pos FROM customer)
SELECT a.user_id, a.pos, n <= 3 + a.pos AS economical FROM actual a JOIN expected e ON a.user_id = e.user_id AND a.pos = e.pos""")
def turn_scores(spark, sf_dir):
    actual = turns(spark, sf_dir).select("user_id", "n", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("long").alias("pos"))
    expected = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("pos"))
    return actual.join(expected, ["user_id", "pos"]).select("user_id", "pos", (F.col("n") <= 3 + F.col("pos")).alias("economical"))


@query("H10 H11", "SELECT conv_id, count(*) AS n, coalesce(max_by(text, turn) FILTER (role = 'assistant' AND trim(text) <> ''), '') AS answer FROM conversations GROUP BY 1")
def last_answer(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    said = (F.col("role") == "assistant") & (F.trim("text") != "")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max_by(F.when(said, F.col("text")), F.when(said, F.col("turn"))), F.lit("")).alias("answer"))


@query("ST2 H11", "SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS history_chars FROM conversations")
def history_growth(spark, sf_dir):
    """Characters said by each turn of a conversation; turns of one number in the order of their roles and texts."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.sum(F.length("text")).over(order).alias("history_chars"))


@query("I8", """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[1-9][0-9]{5}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]', '<id-card>', 'g'),
  '\\b[0-9]{16,19}\\b', '<bank-card>', 'g'), '1[3-9][0-9]{9}', '<phone>', 'g'), '[\\p{L}\\p{N}_.+-]+@[\\p{L}\\p{N}_-]+\\.[\\p{L}\\p{N}_.-]+', '<email>', 'g')) AS masked FROM documents""")
def pii_mask(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.mask(F.col("text"))).alias("masked"))


@query("I8", """SELECT c_custkey, 'id <id-card>, tel <phone>.' AS head, 'pay <bank-card> now' AS item, CASE WHEN c_custkey % 13 = 12 THEN 'no <bank-card>' ELSE 'no <id-card>' END AS checked,
  '<email>' AS value, '4111111111111111' AS key FROM customer""")
def pii_mask_nested(spark, sf_dir):
    """Masking within structs, arrays and map values, keys left alone; a number without a birth date inside is a card's."""
    k = F.col("c_custkey")
    digits = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    month = F.lpad((k % 13 + 1).cast("string"), 2, "0")  # 13 is no month
    number = F.concat(F.lit("1101051977"), month, F.lit("05"), digits(4))
    bad = F.concat(F.lit("110105197713"), digits(6))
    data = F.struct(
        F.concat(F.lit("id 110105199003071"), digits(3), F.lit(", tel 138"), digits(8), F.lit(".")).alias("head"), F.array(F.concat(F.lit("pay 62220210"), digits(11), F.lit(" now"))).alias("items"),
        F.concat(F.lit("no "), F.when(k % 13 == 12, bad).otherwise(number)).alias("checked"), F.create_map(F.lit("4111111111111111"), F.concat(F.lit("c"), k.cast("string"), F.lit("@shop.example.org"))).alias("more"),
    )
    d = load(spark, sf_dir, "customer").select("c_custkey", data.alias("d"))
    m = d.select("c_custkey", text.mask_within(F.col("d"), d.schema["d"].dataType).alias("m"))
    return m.select("c_custkey", "m.head", F.col("m.items")[0].alias("item"), "m.checked", F.map_values("m.more")[0].alias("value"), F.map_keys("m.more")[0].alias("key"))


@query("ST6 ST7 D-8", """WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT event_type, max(value) FILTER (n = least(CAST(floor(total * 0.5) AS BIGINT), total - 1) + 1) AS p50, max(value) FILTER (n = least(CAST(floor(total * 0.9) AS BIGINT), total - 1) + 1) AS p90 FROM x GROUP BY 1""")
def latency_p50_p90(spark, sf_dir):
    """Nearest-rank percentiles by index of each event type's values."""
    return nearest_rank(load(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9})


@query("D-23", "SELECT user_id, date_diff('second', min(ts), max(ts)) AS seconds FROM events GROUP BY 1")
def wallclock_span(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg((F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))).alias("seconds"))


@query("D-22", "SELECT user_id, round(sum(value) FILTER (event_type = 'purchase'), 4) AS tokens FROM events GROUP BY 1")
def generation_tokens(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("tokens"))


@query("ST6", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_ratio FROM events GROUP BY 1 HAVING avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.02")
def hourly_alerts(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("r"))
    return e.filter("r > 0.02").select("hour", "n", F.round("r", 6).alias("error_ratio"))


@query("ST7", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def daily_dashboard(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


#: Spans: a user's events of a day in order, each called by one before it, so that trees are several levels deep; some
#: begin before the one before has ended.
SPANS_SQL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
spans AS (SELECT a.event_id AS span_id, b.event_id AS parent_id, CASE a.event_type WHEN 'view' THEN 'AGENT' WHEN 'click' THEN 'TOOL' ELSE 'GENERATION' END AS kind,
    CASE WHEN a.user_id % 10 = 0 THEN 'test' ELSE 'production' END AS environment, a.event_type AS outcome, epoch_us(a.ts) // 1000000 AS started, epoch_us(a.ts) // 1000000 + CAST(floor(a.value * 60) AS BIGINT) AS ended,
    CAST(floor(a.value) AS BIGINT) AS tokens, a.user_id % 3 AS version, strftime(a.ts, '%Y-%m-%d') AS day
  FROM numbered a LEFT JOIN numbered b ON a.user_id = b.user_id AND CAST(a.ts AS DATE) = CAST(b.ts AS DATE) AND b.i = CASE WHEN a.i % 4 = 1 THEN 0 ELSE a.i - 1 END),
tree AS (SELECT span_id, span_id AS root_id, 0 AS depth FROM spans WHERE parent_id IS NULL UNION ALL SELECT s.span_id, t.root_id, t.depth + 1 FROM spans s JOIN tree t ON s.parent_id = t.span_id),
rooted AS (SELECT * FROM spans JOIN tree USING (span_id))"""


def spans_view(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    order = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    i, before = F.row_number().over(order), F.lag("event_id").over(order)
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("span_id"), F.when(i % 4 != 1, before).alias("parent_id"), F.when(F.col("event_type") == "view", "AGENT").when(F.col("event_type") == "click", "TOOL").otherwise("GENERATION").alias("kind"),
        F.when(F.col("user_id") % 10 == 0, "test").otherwise("production").alias("environment"), F.col("event_type").alias("outcome"), second.alias("started"), (second + F.floor(F.col("value") * 60)).alias("ended"),
        F.floor("value").alias("tokens"), (F.col("user_id") % 3).alias("version"), "day",
    )


def _rooted(spark, sf_dir):
    return S.with_roots(kept(spans_view(spark, sf_dir), "spans"))


@query("A19 D-22 D-23", f"""WITH RECURSIVE {SPANS_SQL},
marked AS (SELECT root_id, started, ended, CASE WHEN started > max(ended) OVER w OR max(ended) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM rooted WINDOW w AS (PARTITION BY root_id ORDER BY started, ended ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
islands AS (SELECT root_id, started, ended, sum(fresh) OVER (PARTITION BY root_id ORDER BY started, ended ROWS UNBOUNDED PRECEDING) AS island FROM marked),
times AS (SELECT root_id, sum(s) AS seconds FROM (SELECT root_id, max(ended) - min(started) AS s FROM islands GROUP BY root_id, island) GROUP BY 1)
SELECT root_id, count(*) AS spans, max(depth) AS deepest, sum(tokens) FILTER (kind = 'GENERATION') AS tokens, any_value(seconds) AS seconds FROM rooted JOIN times USING (root_id) GROUP BY 1""")
def span_trees(spark, sf_dir):
    """Each trace's spans, depth, generated tokens (null without a generation), and time with overlaps counted once."""
    r = kept(_rooted(spark, sf_dir), "rooted")
    t = r.groupBy("root_id").agg(F.count(F.lit(1)).alias("spans"), F.max("depth").alias("deepest"), F.sum(F.when(F.col("kind") == "GENERATION", F.col("tokens"))).alias("tokens"))
    return t.join(S.covered(r, ["root_id"]), "root_id")


_SHARE_SQL = "CAST('0x' || substr(md5(CAST(span_id AS VARCHAR)), 1, 6) AS INTEGER) % 100"


@query("ST8", f"""WITH RECURSIVE {SPANS_SQL},
roots AS (SELECT span_id, {_SHARE_SQL} < 20 AS correctness, {_SHARE_SQL} < 10 AS faithfulness FROM spans WHERE parent_id IS NULL AND kind = 'AGENT' AND environment = 'production' AND outcome IN ('view', 'purchase'))
SELECT root_id, count(*) AS spans, correctness, faithfulness FROM rooted JOIN roots ON root_id = roots.span_id WHERE correctness GROUP BY root_id, correctness, faithfulness""")
def sampled_traces(spark, sf_dir):
    """Traces an evaluator reads, a fifth of them, and which of these another one reads, a tenth: chosen by their root
    observation, which alone is asked for its kind, environment and outcome."""
    r = _rooted(spark, sf_dir)
    root = r.filter((F.col("span_id") == F.col("root_id")) & (F.col("kind") == "AGENT") & (F.col("environment") == "production") & F.col("outcome").isin("view", "purchase"))
    root = root.select("root_id", S.chosen(F.col("root_id"), 20).alias("correctness"), S.chosen(F.col("root_id"), 10).alias("faithfulness")).filter("correctness")
    return r.join(root, "root_id").groupBy("root_id", "correctness", "faithfulness").agg(F.count(F.lit(1)).alias("spans"))


@query("ST7", f"""WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id % 3 AS version, event_type AS outcome, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1 END AS good, value,
    least(CAST(floor(value / 20) AS BIGINT), 9) AS bucket FROM events)
SELECT CASE WHEN GROUPING(day) = 0 AND GROUPING(outcome) = 1 THEN 'trend' WHEN GROUPING(version) = 0 AND GROUPING(outcome) = 1 THEN 'by version' WHEN GROUPING(outcome) = 0 AND GROUPING(day) = 0 THEN 'outcome stack' WHEN GROUPING(bucket) = 0 THEN 'histogram' ELSE 'outcomes by version' END AS view,
  coalesce(day, '') AS day, coalesce(version, -1) AS version, coalesce(outcome, '') AS outcome, coalesce(bucket, -1) AS bucket, count(*) AS n, round(avg(good), 6) AS consistency, round(sum(value), 4) AS cost
FROM s GROUP BY GROUPING SETS ((day), (version), (day, outcome), (bucket), (version, outcome))""")
def dashboard(spark, sf_dir):
    """Five views of one scan: the trend by day, bars by version, outcomes stacked by day, a histogram, outcomes by version."""
    s = load(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 3).alias("version"), F.col("event_type").alias("outcome"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("good"),
        "value", F.least(F.floor(F.col("value") / 20), F.lit(9)).alias("bucket"),
    )
    of = lambda *names: [F.col(n) for n in names]
    g = s.groupingSets([of("day"), of("version"), of("day", "outcome"), of("bucket"), of("version", "outcome")], *of("day", "version", "outcome", "bucket"))
    has = lambda c: F.grouping(c) == 0
    view = F.when(has("day") & ~has("outcome"), "trend").when(has("version") & ~has("outcome"), "by version").when(has("day"), "outcome stack").when(has("bucket"), "histogram").otherwise("outcomes by version")
    g = g.agg(view.alias("view"), F.count(F.lit(1)).alias("n"), F.round(F.avg("good"), 6).alias("consistency"), F.round(F.sum("value"), 4).alias("cost"))
    return g.select("view", F.coalesce("day", F.lit("")).alias("day"), F.coalesce("version", F.lit(-1)).alias("version"), F.coalesce("outcome", F.lit("")).alias("outcome"), F.coalesce("bucket", F.lit(-1)).alias("bucket"), "n", "consistency", "cost")

"""Queries of the scalar functions, caches and joins that the other plans only use in passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from evistra.functions import text as X
from evistra.functions.numbers import fixed
from evistra.operators.semantic import semantic_chunks
from evistra.registry import query
from evistra.sources import readers
from evistra.sources.facades import load
from evistra.sources.shared import folder, kept


@query("I6", """WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '\\s+', '', 'g') AS t FROM conversations)
SELECT a.conv_id, a.turn, count(*) AS phrases, count_if(contains(a.t, substr(b.t, 1, 4))) AS found, count_if(contains(a.t, b.t)) AS whole
FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.role = 'assistant' AND b.role <> 'assistant' GROUP BY 1, 2""")
def loose_containment(spark, sf_dir):
    """How many of the other turns of a conversation, and of their beginnings, an answer holds, white space aside."""
    c = load(spark, sf_dir, "conversations")
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", "text")
    b = c.filter("role <> 'assistant'").select("conv_id", F.col("text").alias("phrase"), F.substring(bare, 1, 4).alias("start"))
    both, text = a.join(b, "conv_id"), F.col("text")
    return both.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("phrases"), F.count_if(X.contains_loosely(text, F.col("start"))).alias("found"), F.count_if(X.contains_loosely(text, F.col("phrase"))).alias("whole"))


@query("I7", """SELECT o_orderkey, array_to_string(regexp_extract_all('(' || CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'D' END || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '),X' || o_custkey || ',R12', '\\b[RD][0-9]{4,}\\b'), ',') AS receipts FROM orders""")
def receipt_numbers(spark, sf_dir):
    letter = F.when(F.col("o_orderstatus") == "F", "R").otherwise("D")
    answer = F.concat(F.lit("( "), letter, F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit(" ), X"), F.col("o_custkey").cast("string"), F.lit(", R12"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.receipts(answer), ",").alias("receipts"))


@query("I14 I16 I17", """SELECT p_partkey, string_split(p_name || '：' || p_type || '：x', '：')[1] AS head,
  array_to_string(list_filter(list_transform(string_split(p_type || ', ,' || p_brand || ',', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags,
  coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END, ''), nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, ''), '') AS authority FROM part""")
def part_labels(spark, sf_dir):
    """The head before the first full-width colon, a comma list as tags, and the first value that isn't empty."""
    unless = lambda n, c: F.nullif(F.when(F.col("p_size") % n == 0, "").otherwise(F.col(c)), F.lit(""))
    return load(spark, sf_dir, "part").select(
        "p_partkey", F.substring_index(F.concat_ws("：", "p_name", "p_type", F.lit("x")), "：", 1).alias("head"),
        F.array_join(readers.tags(F.concat("p_type", F.lit(", ,"), "p_brand", F.lit(","))), "|").alias("tags"),
        F.coalesce(unless(2, "p_brand"), unless(3, "p_type"), F.lit("")).alias("authority"),
    )


@query("I13", "SELECT doc_id, CAST(DATE '2023-01-01' + CAST(doc_id % 730 AS INTEGER) AS DATE) <= current_date AS begun, length(CAST(current_date AS VARCHAR)) AS n FROM documents")
def begun_today(spark, sf_dir):
    """Documents in force by today, as ISO dates compared as text; the day is fixed once for the query."""
    today = F.current_date().cast("string")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 730).cast("int")).cast("string")
    return load(spark, sf_dir, "documents").select("doc_id", (day <= today).alias("begun"), F.length(today).cast("long").alias("n"))


@query("I18 A20", """SELECT event_id, event_type AS kind, value FROM events WHERE event_type IS NOT NULL""")
def json_round_trip(spark, sf_dir):
    """Events to JSON and back without loss."""
    e = load(spark, sf_dir, "events").filter("event_type is not null")
    j = e.select(F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), "value")).alias("j"))
    return j.select(F.from_json("j", "event_id long, kind string, value double").alias("r")).select("r.*")


@query("K7", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'configured' WHEN event_type = 'error' THEN 'prod' ELSE 'eval' END AS environment FROM events""")
def environment_default(spark, sf_dir):
    """The environment as configured; else prod where the request came from it; else eval."""
    configured = F.when(F.col("event_id") % 3 == 0, "configured")
    return load(spark, sf_dir, "events").select("event_id", F.coalesce(configured, F.when(F.col("event_type") == "error", "prod"), F.lit("eval")).alias("environment"))


_PLANS_SQL = """WITH p AS (SELECT item_id, text, item_id % 2 = 0 AS cached, string_split(text, ' ') AS subs FROM benchmark)
SELECT item_id, cached, len(CASE WHEN cached THEN subs ELSE subs[1:3] END) AS n_subs, coalesce(array_to_string(CASE WHEN cached THEN subs ELSE subs[1:3] END, '|'), '') AS subs FROM p"""


@query("A18 F9", _PLANS_SQL)
def rewrite_plan_cache(spark, sf_dir):
    """Plans by query: those in the cache (even ids) as they are, fresh ones cut to three sub-queries."""
    q = load(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("fresh"))
    cache = load(spark, sf_dir, "benchmark").filter("item_id % 2 = 0").select("item_id", F.split("text", " ").alias("known"))
    subs = F.coalesce("known", F.slice("fresh", 1, 3))
    return q.join(cache, "item_id", "left").select("item_id", F.col("known").isNotNull().alias("cached"), F.size(subs).cast("long").alias("n_subs"), F.array_join(subs, "|").alias("subs"))


@query("B10", """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'assistant' AND trim(text) <> '') AS n FROM conversations GROUP BY 1)
SELECT count(*) FILTER (n > 0) AS usable, count(*) FILTER (n = 0) AS skipped FROM c""")
def calibration_filter(spark, sf_dir):
    """Cases whose context isn't empty, and how many are skipped."""
    own = (F.col("role") == "assistant") & (F.trim("text") != "")
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(own).alias("n"))
    return c.agg(F.count_if(F.col("n") > 0).alias("usable"), F.count_if(F.col("n") == 0).alias("skipped"))


@query("C14 A17", """WITH items AS (SELECT doc_id AS item, source, doc_id % 7 AS trace FROM documents), scores AS (SELECT doc_id AS item, 'quality' AS name, quality AS score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
SELECT items.item, source, trace, count(score) AS n_scores, sum(score) AS total FROM items LEFT JOIN scores ON items.item = scores.item GROUP BY 1, 2, 3""")
def run_items(spark, sf_dir):
    """A run's items with their metadata and the scores of their traces; items without scores stay."""
    items = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source", (F.col("doc_id") % 7).alias("trace"))
    s = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("item")).agg((F.count("quality") + F.count("toxic")).alias("n_scores"), F.sum(F.col("quality") + F.col("toxic")).alias("total"))
    return items.join(s, "item", "left").withColumn("n_scores", F.coalesce("n_scores", F.lit(0)))


@query("B13 I11", """WITH o AS (SELECT o_custkey, string_agg('  - O' || o_orderkey || '：' || o_orderpriority || '，实付 ¥' || printf('%.2f', CAST(o_totalprice AS DOUBLE)) || CASE WHEN o_orderstatus = 'F' THEN '，已退款' ELSE '' END, chr(10) ORDER BY o_orderkey) AS lines FROM orders GROUP BY 1)
SELECT c_custkey, md5('客户 C' || c_custkey || '（' || c_name || '）' || chr(10) || '会员等级：' || c_mktsegment || chr(10) || '名下订单：' || chr(10) || coalesce(lines, '  （无）')) AS profile FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def profile_texts(spark, sf_dir):
    """Profiles as an agent reads them: who, level, and the orders in their order, or that there are none."""
    line = F.concat(F.lit("  - O"), F.col("o_orderkey").cast("string"), F.lit("："), "o_orderpriority", F.lit("，实付 ¥"), fixed(F.col("o_totalprice"), 2), F.when(F.col("o_orderstatus") == "F", "，已退款").otherwise(""))
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    c = load(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    head = F.concat(F.lit("客户 C"), F.col("c_custkey").cast("string"), F.lit("（"), "c_name", F.lit("）\n会员等级："), "c_mktsegment", F.lit("\n名下订单：\n"))
    return c.select("c_custkey", F.md5(F.concat(head, F.coalesce("lines", F.lit("  （无）")))).alias("profile"))


@query("A9 A8", """SELECT doc_id AS chunk_id, doc_id % (SELECT max(vec_id) + 1 FROM embeddings) AS vec_id, len(embedding) AS dim FROM documents JOIN embeddings ON doc_id % (SELECT max(vec_id) + 1 FROM embeddings) = vec_id""")
def chunk_vectors(spark, sf_dir):
    """Chunks with their vectors, one to one, written as a table with a fixed schema and read from it."""
    e = load(spark, sf_dir, "embeddings")
    n = (e.agg(F.max("vec_id")).first()[0] or 0) + 1
    c = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % n).alias("vec_id"), "text").join(e.select("vec_id", "embedding"), "vec_id")
    return kept(c.select("chunk_id", "vec_id", "text", "embedding"), "chunk-vectors").select("chunk_id", "vec_id", F.size("embedding").alias("dim"))


@query("H6")
def semantic_split(spark, sf_dir):
    """Sentences of documents, with the vectors that stand in for a model's, in chunks that end where the topic changes."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = (e.agg(F.max("vec_id")).first()[0] or 0) + 1
    s = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("paragraph"), F.posexplode(X.sentences(F.col("text"), "。！？；!?;.", newline=True)).alias("pos", "s"))
    s = s.withColumn("n_tokens", X.token_count(F.col("s"))).withColumn("vec_id", (F.col("paragraph") * 31 + F.col("pos")) % n).join(e, "vec_id")
    return semantic_chunks(s.select("paragraph", "pos", "n_tokens", "vec"), 320, 512)


@query("A6 N12", "SELECT c_custkey AS customer_id, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def seeded_store(spark, sf_dir):
    """A store seeded twice, the second time over the first: its tables hold the rows once, their rules checked."""
    where, c, o = folder(spark, "store"), load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    rules = {"orders": {"price": F.col("o_totalprice") > 0, "status": F.col("o_orderstatus").isin("F", "O", "P")}, "customers": {"id": F.col("c_custkey").isNotNull()}}
    for _ in range(2):
        readers.seed({"customers": c, "orders": o}, where, rules)
    n = spark.read.schema(o.schema).parquet(f"{where}/orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    own = spark.read.schema(c.schema).parquet(f"{where}/customers")
    return own.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("customer_id"), F.coalesce("n", F.lit(0)).alias("orders"))


@query("A19 I8", """SELECT 't' || user_id AS trace_id, count(*) AS spans, count_if(event_type = 'purchase') AS masked FROM events GROUP BY 1""")
def span_sink(spark, sf_dir):
    """Events as spans, appended in two batches with their texts masked, and read again."""
    where, e = folder(spark, "spans"), load(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "purchase", "call 13812345678").otherwise("nothing")
    s = e.select(
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.col("event_type").alias("name"),
        F.lit("tool").alias("kind"), F.col("ts").alias("started"), F.col("ts").alias("ended"), said.alias("input"), F.lit("").alias("output"), (F.col("event_id") % 2).alias("half"),
    )
    for half in (0, 1):
        readers.append_spans(s.filter(F.col("half") == half), where)
    return spark.read.schema(readers.SPANS).parquet(where).groupBy("trace_id").agg(F.count(F.lit(1)).alias("spans"), F.count_if(F.col("input") == "call <phone>").alias("masked"))

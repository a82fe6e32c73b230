"""Queries of the retrieval chain.

Chunks are documents, forty to a text and four to a parent; every chunk has a vector. Queries are every twentieth vector.
Most have a cached plan of one to three sub-queries with intents, vectors and benchmark texts of their own; the others
are passed through as they are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evistra.operators import analysis as A
from evistra.operators import index as I
from evistra.operators import retrieval as R
from evistra.registry import query
from evistra.sources import collection
from evistra.sources.facades import load
from evistra.sources.shared import folder, kept

DAY = "2024-01-01"
CHUNKS_SQL = """
v_chunks AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id // 40 % 3 = 0 THEN 'law' ELSE 'platform' END AS layer, doc_id // 4 AS parent_id, doc_id // 4 % 10 AS parent_seq, doc_id % 4 AS chunk_index,
  'D' || (doc_id // 40) AS doc, CAST(DATE '2023-01-01' + CAST(doc_id % 730 AS INTEGER) AS VARCHAR) AS effective_date,
  CASE WHEN doc_id % 7 = 0 THEN CAST(DATE '2023-01-01' + CAST(doc_id % 730 + 180 AS INTEGER) AS VARCHAR) ELSE '9999-12-31' END AS expire_date, text FROM documents),
live AS (SELECT * FROM v_chunks WHERE effective_date <= '2024-01-01' AND expire_date > '2024-01-01')"""
PLANS_SQL = """
sizes AS (SELECT (SELECT max(vec_id) + 1 FROM embeddings) AS n_vec, (SELECT max(item_id) + 1 FROM benchmark) AS n_text),
q AS (SELECT vec_id AS query_id, vec_id // 20 AS k, vec_id // 20 % 4 <> 3 AS rewritten FROM embeddings WHERE vec_id % 20 = 0),
subs AS (SELECT query_id, 'q' || i AS sub_id, i, rewritten, CASE WHEN rewritten THEN 1 + k % 3 ELSE 1 END AS n_routes, (query_id + i - 1) % n_vec AS vec_id, (k + i - 1) % n_text AS item_id,
  rewritten AND (k % 5 = 0 OR (k + i) % 4 IN (1, 2)) AS law_first FROM q, sizes, range(1, 4) r(i) WHERE i <= CASE WHEN rewritten THEN 1 + k % 3 ELSE 1 END),
routes AS (SELECT *, CASE WHEN law_first THEN 12 ELSE 18 END AS k_platform, CASE WHEN law_first THEN 12 ELSE 5 END AS k_law, CASE WHEN law_first THEN 1.0 ELSE 0.5 END AS law_weight FROM subs)"""


def chunks_view(spark, sf_dir):
    d, day = load(spark, sf_dir, "documents"), lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int")).cast("string")
    k = F.col("doc_id")
    return d.select(
        k.alias("chunk_id"), F.when(F.expr("doc_id div 40") % 3 == 0, "law").otherwise("platform").alias("layer"), F.expr("doc_id div 4").alias("parent_id"), (F.expr("doc_id div 4") % 10).alias("parent_seq"),
        (k % 4).alias("chunk_index"), F.concat(F.lit("D"), F.expr("doc_id div 40").cast("string")).alias("doc"),
        day(k % 730).alias("effective_date"), F.when(k % 7 == 0, day(k % 730 + 180)).otherwise("9999-12-31").alias("expire_date"), "text",
    )


def live_chunks(spark, sf_dir):
    return chunks_view(spark, sf_dir).filter(R.valid_on(DAY))


_INDEXES: dict[tuple, I.Index] = {}


def _index(spark, sf_dir):
    """The index of all chunks, by layer, built once for the tables an application reads."""
    c = chunks_view(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(c.inputFiles()))
    if key not in _INDEXES:
        _INDEXES[key] = I.build(c.select(F.col("chunk_id").alias("doc_id"), "layer", "effective_date", "expire_date", "text"), group="layer")
    return _INDEXES[key]


def _texts(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _sizes(spark, sf_dir):
    """How many vectors and texts there are: both are numbered from 0."""
    v, t = load(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0], load(spark, sf_dir, "benchmark").agg(F.max("item_id")).first()[0]
    return (v or 0) + 1, (t or 0) + 1


def plans(spark, sf_dir):
    """query_id, needs_law, sub_queries, rewritten of every query."""
    n_vec, n_text = _sizes(spark, sf_dir)
    e, b = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "benchmark")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.expr("vec_id div 20").alias("k"), F.col("embedding").alias("vec"))
    vec, text = e.select(F.col("vec_id").alias("v"), "embedding"), b.select(F.col("item_id").alias("t"), "text")
    queries = q.withColumn("t", F.col("k") % n_text).join(text, "t", "left").select("query_id", "text", "vec")
    sub = q.filter("k % 4 <> 3").select("query_id", "k", F.explode(F.sequence(F.lit(1), (1 + F.col("k") % 3).cast("int"))).alias("i"))
    sub = sub.withColumn("v", (F.col("query_id") + F.col("i") - 1) % n_vec).withColumn("t", (F.col("k") + F.col("i") - 1) % n_text).join(vec, "v", "left").join(text, "t", "left")
    intent = F.element_at(F.array(*map(F.lit, ("policy", "validity", "dispute", "other"))), ((F.col("k") + F.col("i")) % 4 + 1).cast("int"))
    s = F.struct(F.concat(F.lit("q"), F.col("i").cast("string")).alias("id"), intent.alias("intent"), "text", F.col("embedding").alias("vec"))
    cache = sub.groupBy("query_id", (F.col("k") % 5 == 0).alias("needs_law")).agg(F.array_sort(F.collect_list(s), lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1)).alias("sub_queries"))
    return R.plans_of(queries, cache)


def _routes(spark, sf_dir):
    return kept(R.routes(plans(spark, sf_dir)), "routes")


@query("L3 K5 K8 C17 A18", f"WITH {PLANS_SQL} SELECT query_id, sub_id, n_routes, k_platform, k_law, law_weight, md5(text) AS asked FROM routes LEFT JOIN benchmark ON routes.item_id = benchmark.item_id")
def plan_routes(spark, sf_dir):
    r = R.routes(plans(spark, sf_dir))
    return r.select("query_id", "sub_id", "n_routes", "k_platform", "k_law", "law_weight", F.md5("text").alias("asked"))


@query("B1 B2 A10", f"WITH {CHUNKS_SQL} SELECT chunk_id, layer, effective_date, expire_date FROM live WHERE layer IN ('law', 'platform')")
def asof_policy_filter(spark, sf_dir):
    return live_chunks(spark, sf_dir).filter(F.col("layer").isin("law", "platform")).select("chunk_id", "layer", "effective_date", "expire_date")


@query("A10 B1 A8", f"WITH {CHUNKS_SQL} SELECT chunk_id, doc, effective_date, expire_date FROM live WHERE layer = 'law'")
def collection_filter(spark, sf_dir):
    """Chunks of one layer in force on a day, from a collection kept by layer and year."""
    where = folder(spark, "collection")
    collection.write(chunks_view(spark, sf_dir), where)
    return collection.read(spark, where, ["law"], DAY).select("chunk_id", "doc", "effective_date", "expire_date")


_DENSE = """dense_scored AS (SELECT query_id, sub_id, layer, chunk_id, round(list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score,
    CASE layer WHEN 'law' THEN k_law ELSE k_platform END AS k FROM live, sizes JOIN embeddings e ON live.chunk_id % sizes.n_vec = e.vec_id, routes JOIN embeddings v ON routes.vec_id = v.vec_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id, sub_id, layer ORDER BY score DESC, chunk_id) AS rank FROM dense_scored QUALIFY rank <= k)"""
_DENSE_SQL = f"WITH {CHUNKS_SQL}, {PLANS_SQL}, {_DENSE} "


def _dense(spark, sf_dir, routes):
    n_vec, _ = _sizes(spark, sf_dir)
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vec"))
    chunks = live_chunks(spark, sf_dir).select("chunk_id", "layer", (F.col("chunk_id") % n_vec).alias("v")).join(e, "v")
    return R.dense_topk(routes, chunks)


@query("E1 F1 C3 A12 A14", _DENSE_SQL + "SELECT query_id, sub_id, layer, chunk_id, score, rank FROM dense")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, _routes(spark, sf_dir))


_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_COUNTS = f"""
toks AS (SELECT doc_id, {_TOK} AS t FROM documents), stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
_PART = "round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6)"
_BM25_SQL = f"""{_COUNTS},
terms AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK})) AS term FROM benchmark),
bm AS (SELECT query_id, doc_id, {_PART} AS score FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY 1, 2)"""


@query("E2 D-7", f"WITH toks AS (SELECT {_TOK} AS t FROM documents) SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avgdl FROM toks")
def bm25_stats(spark, sf_dir):
    return R.bm25_stats(load(spark, sf_dir, "documents")).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("E2 F2 C4 A13", f"WITH {_BM25_SQL} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 18")
def bm25_topk(spark, sf_dir):
    return R.top_k(R.bm25_scores(_texts(spark, sf_dir), load(spark, sf_dir, "documents")), ["query_id"], 18, "doc_id")


_INDEXED_SQL = f"""WITH {_BM25_SQL}, law AS (SELECT doc_id, CASE WHEN doc_id // 40 % 3 = 0 THEN 'law' ELSE 'platform' END AS layer FROM documents)"""


@query("A13 F2 E2", _INDEXED_SQL + """ SELECT query_id, layer, doc_id, score, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, doc_id) AS rank FROM bm JOIN law USING (doc_id) QUALIFY rank <= 18""")
def indexed_topk(spark, sf_dir):
    """The best chunks of each layer for each benchmark text, from the index: what a full scan of the texts gives."""
    found = I.search(_index(spark, sf_dir), _texts(spark, sf_dir), R.MOST_K).rows
    return found.withColumnRenamed("grp", "layer")


def nearest_texts(spark, sf_dir):
    """(query_id, doc_id, score, rank): the best chunks for each benchmark text, from the best of each layer."""
    found = I.search(_index(spark, sf_dir), _texts(spark, sf_dir), R.MOST_K).rows
    return R.top_k(found.select("query_id", "doc_id", "score"), ["query_id"], R.MOST_K, "doc_id")


@query("A13", _INDEXED_SQL + f""",
parts AS (SELECT query_id, layer, doc_id // {I.SEGMENT} AS segment, term, max(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) AS best
  FROM terms JOIN df USING (term) JOIN tf USING (term) JOIN law USING (doc_id), stats GROUP BY 1, 2, 3, 4),
heads AS (SELECT query_id, layer, segment, count(*) AS n, round(sum(best), 6) AS bound FROM parts GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY bound DESC, segment) <= {I.FIRST} AS front FROM heads),
first AS (SELECT query_id, layer, score, row_number() OVER (PARTITION BY query_id, layer ORDER BY score DESC, doc_id) AS rank FROM bm JOIN law USING (doc_id) JOIN placed USING (query_id, layer) WHERE front AND segment = doc_id // {I.SEGMENT})
SELECT query_id, layer, CAST(sum(n) AS BIGINT) AS blocks, CAST(sum(n) FILTER (front OR score IS NULL OR bound >= score - {I.SLACK}) AS BIGINT) AS blocks_read
FROM placed LEFT JOIN (SELECT query_id, layer, score FROM first WHERE rank = 18) USING (query_id, layer) GROUP BY 1, 2""")
def index_blocks_read(spark, sf_dir):
    """How many blocks hold terms of a text, by layer, and how many of them its search reads; the others can't enter."""
    heads = I.search(_index(spark, sf_dir), _texts(spark, sf_dir), R.MOST_K).heads
    return heads.groupBy("query_id", F.col("grp").alias("layer")).agg(F.sum("n_blocks").alias("blocks"), F.sum(F.when(F.col("read"), F.col("n_blocks")).otherwise(0)).alias("blocks_read"))


#: Letters as ideographs, one for each, so that texts without spaces can be made of the given ones.
_LATIN = "abcdefghijklmnopqrstuvwxyzàâäçèéêëîïñóôöùûüÿßíáú"
_HAN = "".join(chr(0x4E00 + 97 * i) for i in range(len(_LATIN)))
_HAN_SQL = f"translate(lower(text), '{_LATIN}', '{_HAN}')"
_RUNS_SQL = rf"""
said AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, translate(regexp_replace({_HAN_SQL}, '\s+', '', 'g'), '.,', '。，') AS t FROM conversations),
counted AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_HAN_SQL}, '[\x{{4e00}}-\x{{9fff}}]+')) AS word FROM documents) WHERE length(word) <= {A.LONGEST} GROUP BY 1 ORDER BY n DESC, word LIMIT {A.LEXICON_WORDS}),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM counted),
lex AS (SELECT word, CAST(round(1000 * ln(n / total)) AS BIGINT) AS w FROM counted, total),
least AS (SELECT CAST(round(1000 * ln(1.0 / total)) AS BIGINT) AS least FROM total),
runs AS (SELECT DISTINCT unnest(regexp_extract_all(t, '[\x{{4e00}}-\x{{9fff}}]+')) AS run FROM said),
spans AS (SELECT run, i, k, substr(run, i, k) AS word FROM (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM runs), range(1, {A.LONGEST + 1}) r(k) WHERE i + k <= length(run) + 1),
edges AS (SELECT run, i, k, coalesce(w, least) AS w FROM spans LEFT JOIN lex USING (word), least WHERE w IS NOT NULL OR k = 1),
best AS (SELECT run, length(run) + 1 AS i, [struct_pack(s := CAST(0 AS BIGINT), k := CAST(0 AS BIGINT))] AS b FROM runs
  UNION ALL SELECT best.run, best.i - 1, list_prepend(max(struct_pack(s := e.w + best.b[e.k].s, k := CAST(e.k AS BIGINT))), best.b) FROM best JOIN edges e ON e.run = best.run AND e.i = best.i - 1 GROUP BY best.run, best.i, best.b),
walk AS (SELECT run, b, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS word FROM best WHERE i = 1
  UNION ALL SELECT run, b, i + b[i].k, n + 1, substr(run, i, b[i].k) FROM walk WHERE i <= length(run)),
cut AS (SELECT run, list(word ORDER BY n) AS words FROM walk WHERE n > 0 GROUP BY 1)"""
_SAID_SQL = rf"""WITH RECURSIVE {_RUNS_SQL},
parts AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\x{{4e00}}-\x{{9fff}}]+|[^\x{{4e00}}-\x{{9fff}}\P{{L}}]+|\p{{N}}+')) AS part, generate_subscripts(regexp_extract_all(t, '[\x{{4e00}}-\x{{9fff}}]+|[^\x{{4e00}}-\x{{9fff}}\P{{L}}]+|\p{{N}}+'), 1) AS p FROM said),
toks AS (SELECT said.doc_id, coalesce(own, []) AS t FROM said LEFT JOIN (SELECT doc_id, flatten(list(coalesce(words, [part]) ORDER BY p)) AS own FROM parts LEFT JOIN cut ON part = run GROUP BY 1) USING (doc_id))"""


def _said(spark, sf_dir):
    """Turns of conversations as texts without spaces, and the analyzer of a lexicon of all documents' words."""
    han = lambda c: F.translate(F.lower(c), _LATIN, _HAN)
    c = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "turn", F.translate(F.regexp_replace(han(F.col("text")), r"\s+", ""), ".,", "。，").alias("text"))
    # words are counted in the documents' own letters, so that distinct words are turned into ideographs, not all texts
    words = A.word_counts(load(spark, sf_dir, "documents"), f"[{_LATIN}{A.IDEOGRAPHS[1:]}+")
    words = words.groupBy(han(F.col("word")).alias("word")).agg(F.sum("n").alias("n"))
    return c, A.analyzer(A.lexicon(words))


@query("E2", _SAID_SQL + " SELECT doc_id, len(t) AS n, md5(array_to_string(t, '/')) AS digest FROM toks")
def chinese_terms(spark, sf_dir):
    """Texts without spaces in words: how many, and a digest of them all in order."""
    c, analyze = _said(spark, sf_dir)
    t = c.select("doc_id", analyze(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "/")).alias("digest"))


@query("E2 A13 F2", _SAID_SQL + f""", stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks),
tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
terms AS (SELECT doc_id AS query_id, unnest(list_distinct(t)) AS term FROM toks WHERE doc_id // 1000 % 20 = 0 AND doc_id % 1000 = 0),
bm AS (SELECT query_id, doc_id, {_PART} AS score FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY 1, 2)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 18""")
def chinese_topk(spark, sf_dir):
    """The turns nearest by BM25 to the first turn of every twentieth conversation, by the words inside their sentences."""
    c, analyze = _said(spark, sf_dir)
    index = I.build(c.select("doc_id", "text"), analyze)
    queries = c.filter("conv_id % 20 = 0 and turn = 0").select(F.col("doc_id").alias("query_id"), "text")
    return I.search(index, queries, R.MOST_K, analyze=analyze).rows.drop("grp")


_RANKED_SQL = f"""WITH {CHUNKS_SQL}, {PLANS_SQL}, {_DENSE}, {_COUNTS},
terms AS (SELECT query_id, sub_id, any_value(k_platform) AS k_platform, any_value(k_law) AS k_law, unnest(list_distinct({_TOK})) AS term FROM routes JOIN benchmark ON routes.item_id = benchmark.item_id GROUP BY query_id, sub_id, text),
bm AS (SELECT query_id, sub_id, k_platform, k_law, doc_id, {_PART} AS score FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY 1, 2, 3, 4, 5),
sparse AS (SELECT query_id, sub_id, layer, chunk_id, score, row_number() OVER (PARTITION BY query_id, sub_id, layer ORDER BY score DESC, chunk_id) AS rank
  FROM bm JOIN live ON doc_id = chunk_id QUALIFY rank <= CASE layer WHEN 'law' THEN k_law ELSE k_platform END),
ranked AS (SELECT query_id, sub_id, layer, 1 AS p, 'bm25' AS path, chunk_id, score, rank FROM sparse UNION ALL SELECT query_id, sub_id, layer, 0, 'dense', chunk_id, score, rank FROM dense),
hits AS (SELECT *, CASE layer WHEN 'platform' THEN 0 ELSE 1 END AS l, sub_id || '/' || layer || '/' || path || '#' || rank AS tag, sub_id || '|' || CASE layer WHEN 'platform' THEN 0 ELSE 1 END || '|' || p || '|' || lpad(CAST(rank AS VARCHAR), 4, '0') AS ord FROM ranked),
fused AS (SELECT query_id, chunk_id, sum(CAST(1 AS DOUBLE) / (20 + rank) ORDER BY ord) AS rrf, string_agg(tag, ', ' ORDER BY ord) AS hits, count(DISTINCT sub_id) AS n_subs, min(ord) AS first_seen, arg_min(score, ord) AS first_score FROM hits GROUP BY 1, 2)
"""


def _ranked(spark, sf_dir, routes):
    """Ranked lists of both paths for each sub-query and layer; dated chunks only."""
    k = F.when(F.col("grp") == "law", F.col("k_law")).otherwise(F.col("k_platform"))
    cols = ("query_id", "sub_id", "layer", "path", "chunk_id", "score", "rank")
    found = I.search(_index(spark, sf_dir), routes.select("query_id", "sub_id", "text", "k_platform", "k_law"), k, ("query_id", "sub_id"), R.valid_on(DAY), R.MOST_K).rows
    sparse = found.withColumnsRenamed({"grp": "layer", "doc_id": "chunk_id"}).withColumn("path", F.lit("bm25"))
    return sparse.select(*cols).union(_dense(spark, sf_dir, routes).withColumn("path", F.lit("dense")).select(*cols))


def _fused(spark, sf_dir):
    """(routes, fused rows), each made once."""
    routes = _routes(spark, sf_dir)
    return routes, kept(R.fuse(_ranked(spark, sf_dir, routes)), "fused")


@query("G1 D-1 D-2 D-3 H1 C5", _RANKED_SQL + "SELECT query_id, chunk_id, round(rrf, 6) AS rrf, hits, n_subs, first_score FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)[1].select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), F.array_join("hits", ", ").alias("hits"), "n_subs", "first_score")


_CANDS_SQL = _RANKED_SQL.rstrip() + """,
global_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf + CASE WHEN n_subs = 1 THEN 0.02 ELSE 0 END, 9) DESC, round(rrf, 9) DESC, first_seen, chunk_id) AS g FROM fused),
local AS (SELECT query_id, sub_id, chunk_id, row_number() OVER (PARTITION BY query_id, sub_id ORDER BY round(sum(1.0 / (20 + rank)), 9) DESC, min(ord), chunk_id) AS place FROM hits GROUP BY 1, 2, 3),
quota AS (SELECT query_id, greatest(1, 20 // any_value(n_routes)) AS quota, any_value(n_routes) AS n_routes, min(law_weight) AS law_weight FROM routes GROUP BY 1),
t1 AS (SELECT query_id, chunk_id, sub_id, place FROM local JOIN quota USING (query_id) WHERE sub_id = 'q1' AND place <= quota),
t2 AS (SELECT query_id, chunk_id, sub_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM local ANTI JOIN t1 USING (query_id, chunk_id) JOIN quota USING (query_id) WHERE sub_id = 'q2' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= any_value(quota) OVER (PARTITION BY query_id)),
t12 AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2),
t3 AS (SELECT query_id, chunk_id, sub_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM local ANTI JOIN t12 USING (query_id, chunk_id) JOIN quota USING (query_id) WHERE sub_id = 'q3' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= any_value(quota) OVER (PARTITION BY query_id)),
taken AS (SELECT * FROM t12 UNION ALL SELECT * FROM t3),
cands AS (SELECT f.*, t.sub_id AS turn, row_number() OVER (PARTITION BY f.query_id ORDER BY coalesce(t.sub_id, 'z'), t.place, g) AS rank FROM global_ f LEFT JOIN taken t ON f.query_id = t.query_id AND f.chunk_id = t.chunk_id QUALIFY rank <= 20)
"""


def _candidates(spark, sf_dir):
    routes, fused = _fused(spark, sf_dir)
    return routes, kept(R.routed_candidates(fused, routes), "candidates")


@query("L4 F3 F4 F5", _CANDS_SQL + "SELECT query_id, chunk_id, round(rrf, 6) AS rrf, rank FROM cands")
def recall_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)[1].select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), "rank")


@query("G4 C6", _CANDS_SQL + "SELECT query_id, turn, chunk_id, rank FROM cands WHERE turn IS NOT NULL")
def route_quota_merge(spark, sf_dir):
    """The candidates that sub-queries gave by their quota, with the sub-query whose turn it was."""
    return _candidates(spark, sf_dir)[1].filter("turn is not null").select("query_id", "turn", "chunk_id", "rank")


_EVIDENCE_SQL = _CANDS_SQL.rstrip() + """,
rated AS (SELECT c.query_id, c.chunk_id, c.rank, c.hits, n_routes, v.doc, rrf / max(rrf) OVER (PARTITION BY c.query_id) AS relevance,
    CAST(CASE WHEN layer = 'law' THEN law_weight ELSE 1.0 END AS DOUBLE) * CAST(CASE v.doc WHEN 'D1' THEN 1.0 WHEN 'D2' THEN 0.95 ELSE 0.9 END AS DOUBLE) AS prior
  FROM cands c JOIN v_chunks v ON c.chunk_id = v.chunk_id JOIN quota USING (query_id)),
scored AS (SELECT *, round(raw, 6) AS score FROM (SELECT *, CAST(0.8 AS DOUBLE) * relevance + CAST(0.2 AS DOUBLE) * prior AS raw FROM rated)),
by_score AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS p FROM scored WHERE score >= 0.3),
lead1 AS (SELECT query_id, chunk_id, 1 AS turn FROM by_score WHERE n_routes > 1 AND contains(', ' || hits, ', q1/') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) = 1),
lead2 AS (SELECT query_id, chunk_id, 2 AS turn FROM by_score ANTI JOIN lead1 USING (query_id, chunk_id) WHERE n_routes > 1 AND contains(', ' || hits, ', q2/') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) = 1),
lead12 AS (SELECT * FROM lead1 UNION ALL SELECT * FROM lead2),
lead3 AS (SELECT query_id, chunk_id, 3 AS turn FROM by_score ANTI JOIN lead12 USING (query_id, chunk_id) WHERE n_routes > 1 AND contains(', ' || hits, ', q3/') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) = 1),
leads AS (SELECT * FROM lead12 UNION ALL SELECT * FROM lead3),
evidence AS (SELECT b.query_id, b.chunk_id, b.score, b.raw, b.relevance, b.prior, b.hits, b.doc, row_number() OVER (PARTITION BY b.query_id ORDER BY coalesce(l.turn, 9), p) AS place FROM by_score b LEFT JOIN leads l ON b.query_id = l.query_id AND b.chunk_id = l.chunk_id)
"""


def _evidence(spark, sf_dir):
    """(routes, candidates, evidence), each made once."""
    routes, cands = _candidates(spark, sf_dir)
    c = cands.join(chunks_view(spark, sf_dir).select("chunk_id", "layer", "doc", "parent_id", "parent_seq", "chunk_index"), "chunk_id")
    c = c.join(routes.groupBy("query_id").agg(F.min("law_weight").alias("law_weight")), "query_id")
    priors = spark.createDataFrame([("D1", 1.0), ("D2", 0.95)], "doc string, doc_prior double")
    e = R.routed_evidence(R.rerank(c, priors).select("query_id", "chunk_id", "hits", "n_routes", "doc", "parent_id", "parent_seq", "chunk_index", "score", "relevance", "prior", "why", "place"))
    return routes, cands, kept(e, "evidence")


@query("L5 E5 E6 B5 F6 D-4 D-5 C15", _EVIDENCE_SQL + "SELECT query_id, chunk_id, score, round(relevance, 6) AS relevance, round(prior, 6) AS prior, place FROM evidence")
def rerank_scores(spark, sf_dir):
    return _evidence(spark, sf_dir)[2].select("query_id", "chunk_id", "score", F.round("relevance", 6).alias("relevance"), F.round("prior", 6).alias("prior"), "place")


@query("I22", _EVIDENCE_SQL + "SELECT query_id, chunk_id, printf('相关性 %.3f × 先验 %.2f → %.3f；命中 ', relevance, prior, raw) || hits AS why FROM evidence")
def evidence_reasons(spark, sf_dir):
    return _evidence(spark, sf_dir)[2].select("query_id", "chunk_id", "why")


@query("C7", _EVIDENCE_SQL + "SELECT query_id, chunk_id FROM cands EXCEPT SELECT query_id, chunk_id FROM evidence WHERE place <= 4")
def dropped_candidates(spark, sf_dir):
    _, c, e = _evidence(spark, sf_dir)
    return c.select("query_id", "chunk_id").join(e.filter("place <= 4").select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


@query("G5", _EVIDENCE_SQL + "SELECT e.query_id, e.chunk_id, l.turn, e.place FROM evidence e JOIN leads l ON e.query_id = l.query_id AND e.chunk_id = l.chunk_id")
def route_evidence(spark, sf_dir):
    """The rows put in front for a sub-query's sake: those that stand higher than their score alone would put them, or
    lead a query of several sub-queries."""
    e = _evidence(spark, sf_dir)[2].filter("n_routes > 1")
    subs = F.array_distinct(F.transform("hits", lambda h: F.substring_index(h, "/", 1)))
    n = e.select("query_id", F.explode(subs).alias("s")).groupBy("query_id").agg(F.count_distinct("s").alias("found"))
    front = e.join(n, "query_id").filter(F.col("place") <= F.col("found"))
    # which sub-query a row in front stands for: the n-th of those found that had a row left
    order = F.array_sort(F.array_distinct(F.flatten(F.collect_list(subs))))
    named = e.groupBy("query_id").agg(order.alias("order"))
    return front.join(named, "query_id").select("query_id", "chunk_id", F.substring(F.element_at("order", F.col("place").cast("int")), 2, 1).cast("int").alias("turn"), "place")


@query("C8 A11 D-6", f"WITH {CHUNKS_SQL} SELECT parent_id, count(*) AS n_children, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS digest FROM v_chunks GROUP BY 1")
def parent_backfill(spark, sf_dir):
    return R.parent_text(chunks_view(spark, sf_dir)).select("parent_id", "n_children", F.md5("text").alias("digest"))


@query("H7", f"""WITH {CHUNKS_SQL}, hits AS (SELECT 0 AS query_id, parent_id, chunk_index, chunk_id, chunk_id % 9 = 0 AS hit FROM v_chunks),
near AS (SELECT *, max(hit) OVER (PARTITION BY query_id, parent_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS close,
  max(hit) OVER (PARTITION BY query_id, parent_id) AS any_hit, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY chunk_index) AS n FROM hits)
SELECT query_id, parent_id, chunk_index, chunk_id, hit FROM near WHERE close OR (NOT any_hit AND n = 1)""")
def hit_window(spark, sf_dir):
    c = chunks_view(spark, sf_dir).select(F.lit(0).alias("query_id"), "parent_id", "chunk_index", "chunk_id", (F.col("chunk_id") % 9 == 0).alias("hit"))
    return R.hit_window(c)


@query("L6 C9 F7 F8 G7 I21")
def assemble_sections(spark, sf_dir):
    return _sections(spark, sf_dir, _evidence(spark, sf_dir)[2])


def _children(spark, sf_dir, evidence):
    """Chunks of the parents that evidence names. Up to TERM_ROWS parents go to the chunks, so that the other parents' texts
    are neither shuffled nor tokenised; more are joined."""
    named = kept(evidence.select("doc", "parent_seq").distinct(), "named")
    small = F.broadcast(named) if named.count() <= R.TERM_ROWS else named
    return chunks_view(spark, sf_dir).join(small, ["doc", "parent_seq"], "left_semi").select("doc", "parent_seq", F.col("chunk_index").cast("int").alias("chunk_index"), F.size(R.tokens(F.col("text"))).alias("n_tokens"), "text")


def _sections(spark, sf_dir, evidence):
    kids = _children(spark, sf_dir, evidence)
    path = F.format_string("§%d", "parent_seq").alias("path")
    return R.assemble(evidence.select("query_id", "place", "score", "doc", "parent_seq", F.col("chunk_index").cast("int").alias("chunk_index"), path, "why"), kids)


_TRACE_SQL = _EVIDENCE_SQL + """SELECT q.query_id, n_routes, coalesce(c.ids, '') AS candidate_ids, coalesce(e.ids, '') AS evidence_ids,
  CASE WHEN c.ids IS NULL THEN 'no_candidates' WHEN e.ids IS NULL THEN 'no_evidence' ELSE 'ok' END AS status,
  'rewrite: ' || n_routes || ' | recall: ' || coalesce(c.n, 0) || ' | rerank: ' || coalesce(e.n, 0) AS steps
FROM quota q LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM cands GROUP BY 1) c ON q.query_id = c.query_id
LEFT JOIN (SELECT query_id, count(*) AS n, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY place) AS ids FROM evidence GROUP BY 1) e ON q.query_id = e.query_id"""


def _trace(routes, cands, evidence):
    """What each step found for every query, and a status in place of an error."""
    ids = lambda df, by: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    q = routes.groupBy("query_id").agg(F.first("n_routes").alias("n_routes"))
    t = q.join(ids(cands, "rank").withColumnRenamed("ids", "candidate_ids"), "query_id", "left").join(ids(evidence, "place").withColumnRenamed("ids", "evidence_ids"), "query_id", "left")
    status = F.when(F.col("candidate_ids").isNull(), "no_candidates").when(F.col("evidence_ids").isNull(), "no_evidence").otherwise("ok")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    steps = F.concat_ws(" | ", F.format_string("rewrite: %d", "n_routes"), F.concat(F.lit("recall: "), n("candidate_ids")), F.concat(F.lit("rerank: "), n("evidence_ids")))
    return t.withColumn("status", status).withColumn("steps", steps)


@query("L7 N15", _TRACE_SQL)
def search_trace(spark, sf_dir):
    joined = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("")).alias(c)
    return _trace(*_evidence(spark, sf_dir)).select("query_id", "n_routes", joined("candidate_ids"), joined("evidence_ids"), "status", "steps")


@query("L7 N15")
def search_policy_batch(spark, sf_dir):
    """All queries through the chain: their sections, what was found, and a status in place of errors."""
    routes, cands, evidence = _evidence(spark, sf_dir)
    line = F.struct("section", "doc", "score", "label", "why", "n_tokens", "repeated", "text")
    s = _sections(spark, sf_dir, evidence).groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("sections"))
    return _trace(routes, cands, evidence).join(s, "query_id", "left")


_TERMS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{2,}}|[0-9]+'))"


@query("C18 F13 E9", f"""WITH t AS (SELECT doc_id, source, {_TERMS.format("text")} AS terms, {_TERMS.format("source || ' ' || lang")} AS path FROM documents),
q AS (SELECT item_id, {_TERMS.format("text || ' src' || item_id % 20 || ' en'")} AS want FROM benchmark),
s AS (SELECT item_id, source, doc_id, 3 * len(list_intersect(want, path)) + len(list_intersect(want, terms)) AS overlap FROM q, t)
SELECT item_id, source, max(overlap) AS overlap, max(overlap * 1000000000 + doc_id) % 1000000000 AS doc_id FROM s WHERE overlap > 0 GROUP BY 1, 2""")
def term_overlap(spark, sf_dir):
    """The document of each source that shares most terms with each benchmark text (a stated set), terms of its path three
    times; ties: largest id. Only documents that share a term meet a text, by the terms themselves."""
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}|[0-9]+"), F.lit(0)))
    want = load(spark, sf_dir, "benchmark").select("item_id", F.explode(terms(F.concat("text", F.lit(" src"), (F.col("item_id") % 20).cast("string"), F.lit(" en")))).alias("term"))
    want = kept(want, "wanted-terms")
    small = F.broadcast(want) if want.count() <= R.TERM_ROWS else want
    d = load(spark, sf_dir, "documents")
    body = d.select("doc_id", "source", F.explode(terms("text")).alias("term"), F.lit(1).alias("weight"))
    path = d.select("doc_id", "source", F.explode(terms(F.concat_ws(" ", "source", "lang"))).alias("term"), F.lit(3).alias("weight"))
    pairs = body.union(path).join(small, "term").groupBy("item_id", "source", "doc_id").agg(F.sum("weight").alias("overlap"))
    best = pairs.groupBy("item_id", "source").agg(F.max(F.struct("overlap", "doc_id")).alias("m"))
    return best.select("item_id", "source", "m.overlap", "m.doc_id")

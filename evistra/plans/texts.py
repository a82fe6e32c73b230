"""Queries over texts: sentences, lengths, chunks, terms, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evistra.functions import text as X
from evistra.operators import chunking, tables
from evistra.registry import query
from evistra.sources.facades import load
from evistra.sources.shared import kept


@query("I3", """WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?;])', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM s WHERE trim(s, ' ' || chr(10)) <> '' GROUP BY 1""")
def sentence_split(spark, sf_dir):
    s = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"(?<=[.!?;])")).alias("s"))
    return s.filter(F.trim(F.translate("s", "\n", " ")) != "").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query("D-8 D-9 E7", """WITH l AS (SELECT len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents), o AS (SELECT n, row_number() OVER (ORDER BY n) AS k, count(*) OVER () AS total FROM l)
SELECT max(n) FILTER (k = least(CAST(floor(total * 0.5) AS BIGINT), total - 1) + 1) AS p50, max(n) FILTER (k = least(CAST(floor(total * 0.99) AS BIGINT), total - 1) + 1) AS p99, max(n) AS longest, count_if(n > 1024) AS truncated FROM o""")
def token_length_report(spark, sf_dir):
    """Nearest-rank percentiles by index from counts of each length: the window sees lengths, not documents."""
    n = F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    c = load(spark, sf_dir, "documents").groupBy(n.alias("n")).agg(F.count(F.lit(1)).alias("k"))
    c = c.withColumn("upto", F.sum("k").over(Window.orderBy("n"))).withColumn("total", F.sum("k").over(Window.partitionBy(F.lit(1))))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * p), F.col("total") - 1), F.col("n")))
    return c.agg(at(0.5).alias("p50"), at(0.99).alias("p99"), F.max("n").alias("longest"), F.coalesce(F.sum(F.when(F.col("n") > 1024, F.col("k"))), F.lit(0)).alias("truncated"))


def _sentence_vectors(spark, sf_dir):
    """Gives sentences the vectors that stand in for a model's; a sentence without one ends no topic."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vec"))
    n = (e.agg(F.max("v")).first()[0] or 0) + 1
    return lambda said: said.withColumn("v", F.pmod(F.crc32(F.col("paragraph").cast("binary")) * 31 + F.col("pos"), F.lit(n))).join(e, "v", "left").drop("v")


@query("L1 H2 H3 H4 H5 H6 I1 I2 I5")
def chunk_documents(spark, sf_dir):
    """Documents in chunks; a paragraph over the limit ends where its topic changes. Full stops end sentences, too."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body"))
    return chunking.chunk_documents(docs, _sentence_vectors(spark, sf_dir), chunking.TERMINATORS + ".")


@query("L1 I1 I5", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
t AS (SELECT doc_id, regexp_replace(string_agg(line, '' ORDER BY n), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '', 'g') AS t
  FROM l WHERE NOT regexp_matches(line, '^(#{1,6}\s+.*|\s*(-{3,}|\*{3,}|_{3,})\s*)$') GROUP BY 1)
SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM t WHERE t <> ''""")
def chunk_text_kept(spark, sf_dir):
    """What the chunks of each document hold, white space aside: all of it but headings and rules, in order."""
    c = chunk_documents(spark, sf_dir)
    line = F.array_sort(F.collect_list(F.struct("parent_seq", "chunk_index", "body")))
    t = c.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.regexp_replace(F.array_join(F.transform(line, lambda x: x["body"]), ""), r"(?U)[\s\x1c-\x1f]+", "").alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


@query("H5")
def greedy_pack(spark, sf_dir):
    c = chunk_documents(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(X.token_count(F.col("body"))).alias("longest"))


@query("D-7", "SELECT source, count(*) AS n, count(DISTINCT doc_id // 4) AS parents FROM documents GROUP BY 1")
def counts_per_document(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.expr("doc_id div 4")).alias("parents"))


@query("B3 B15 I11", "SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS excerpt, source || ' > ' || lang AS section, lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def excerpts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"), F.concat_ws(" > ", "source", "lang").alias("section"), F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("padded"))


@query("H14", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, n - 1 AS line, sum(CASE WHEN contains(line, '|') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS fenced FROM l""")
def fence_state(spark, sf_dir):
    """Which lines lie between fence lines (here: lines with a bar), by the parity of the fences so far."""
    l = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))  # noqa: E741
    n = F.sum(F.col("s").contains("|").cast("int")).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return l.select("doc_id", F.col("line").cast("long").alias("line"), (n % 2 == 1).alias("fenced"))


_POOL_SQL = """WITH chunks AS (SELECT doc_id, source, CASE WHEN contains(text, ' | ') THEN 'table' ELSE 'text' END AS kind, CASE WHEN doc_id % 23 = 0 THEN substr(text, 1, 60) || '：' ELSE text END AS body,
    CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN '相关文件 > x' ELSE source || ' > ' || lang END AS path, md5('20260817:' || doc_id) AS draw FROM documents),
pool AS (SELECT *, length(body) AS n FROM chunks WHERE length(trim(body, ' ' || chr(9) || chr(10) || chr(13))) >= 30 AND NOT (length(trim(body, ' ' || chr(9) || chr(10) || chr(13))) < 80 AND ends_with(trim(body, ' ' || chr(9) || chr(10) || chr(13)), '：')) AND trim(path) <> '' AND NOT starts_with(path, '相关文件')),
line AS (SELECT n AS short_line FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM pool) WHERE i = total // 3),
quota AS (SELECT source, 2 + CASE WHEN count(*) >= 20 THEN 1 ELSE 0 END AS quota FROM pool GROUP BY 1),
tables AS (SELECT doc_id, source FROM pool WHERE kind = 'table' QUALIFY row_number() OVER (PARTITION BY source ORDER BY draw) = 1),
shorts AS (SELECT doc_id, source FROM pool, line WHERE n <= short_line AND doc_id NOT IN (SELECT doc_id FROM tables) QUALIFY row_number() OVER (PARTITION BY source ORDER BY draw) = 1),
first AS (SELECT *, 'table' AS stratum FROM tables UNION ALL SELECT *, 'short' FROM shorts), n_first AS (SELECT source, count(*) AS k FROM first GROUP BY 1),
rest AS (SELECT doc_id, pool.source, row_number() OVER (PARTITION BY pool.source ORDER BY draw) + coalesce(k, 0) AS place FROM pool LEFT JOIN n_first ON pool.source = n_first.source WHERE doc_id NOT IN (SELECT doc_id FROM first)),
seeds AS (SELECT source, doc_id, stratum FROM first UNION ALL SELECT rest.source, doc_id, 'rest' FROM rest JOIN quota ON rest.source = quota.source WHERE place <= quota)
"""


@query("L13 B4 D-10", _POOL_SQL + "SELECT source, stratum, doc_id FROM seeds")
def stratified_seeds(spark, sf_dir):
    """Two usable chunks a source (three where twenty are usable), a table and a short one among them where there are any,
    the same at every run. Only the few least draws of each source and kind are ranked together."""
    d = load(spark, sf_dir, "documents")
    c = d.select(
        "doc_id", "source", F.when(F.contains("text", F.lit(" | ")), "table").otherwise("text").alias("kind"), F.when(F.col("doc_id") % 23 == 0, F.concat(F.substring("text", 1, 60), F.lit("："))).otherwise(F.col("text")).alias("body"),
        F.when(F.col("doc_id") % 17 == 0, "").when(F.col("doc_id") % 19 == 0, "相关文件 > x").otherwise(F.concat_ws(" > ", "source", "lang")).alias("path"), F.md5(F.concat(F.lit("20260817:"), F.col("doc_id").cast("string"))).alias("draw"),
    )
    pool = kept(c.filter(usable(F.col("body"), F.col("path"))).select("doc_id", "source", "kind", "draw", F.length("body").alias("n")), "seed-pool")
    lengths = pool.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("n"))).withColumn("total", F.sum("k").over(Window.partitionBy(F.lit(1))))
    line = lengths.agg(F.min(F.when(F.col("upto") > F.floor(F.col("total") / 3), F.col("n"))).alias("line"))
    quota = pool.groupBy("source").agg((2 + (F.count(F.lit(1)) >= 20).cast("int")).alias("quota"))
    p = pool.crossJoin(F.broadcast(line)).withColumn("short", F.col("n") <= F.col("line"))
    least = lambda rows, k: rows.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("draw"))).filter(F.col("i") <= k).drop("i")
    few = least(p.filter("kind = 'table'"), 1).union(least(p.filter("short"), 2)).union(least(p, 5)).distinct()  # at most 8 a source
    by = Window.partitionBy("source")
    few = few.withColumn("t", (F.col("kind") == "table") & (F.col("draw") == F.min(F.when(F.col("kind") == "table", F.col("draw"))).over(by)))
    few = few.withColumn("s", F.coalesce(F.col("short") & ~F.col("t") & (F.col("draw") == F.min(F.when(F.col("short") & ~F.col("t"), F.col("draw"))).over(by)), F.lit(False)))
    stratum = F.when(F.col("t"), "table").when(F.col("s"), "short").otherwise("rest")
    placed = few.withColumn("stratum", stratum).withColumn("place", F.row_number().over(by.orderBy(F.when(F.col("t"), 0).when(F.col("s"), 1).otherwise(2), "draw")))
    return placed.join(quota, "source").filter("place <= quota").select("source", "stratum", "doc_id")


def usable(body, path):
    """Whether a case can be made of a chunk: long enough, not a short lead to what follows, not an introduction or a list of links."""
    b = X.strip(body)
    return (F.length(b) >= 30) & ~((F.length(b) < 80) & b.endswith("：")) & (F.trim(path) != "") & ~path.startswith("相关文件")


@query("L14", _POOL_SQL + """, two AS (SELECT source, doc_id, unnest(['formal', 'colloquial']) AS style FROM seeds)
SELECT 'R1-' || lpad(CAST(row_number() OVER (ORDER BY source, doc_id, style DESC) AS VARCHAR), 3, '0') AS case_id, style || ' question on ' || doc_id AS question, doc_id FROM two""")
def seed_cases(spark, sf_dir):
    """Two cases a seed, asked formally and colloquially, numbered in the order of the seeds; a model would word them."""
    two = stratified_seeds(spark, sf_dir).select("source", "doc_id", F.explode(F.array(F.lit("formal"), F.lit("colloquial"))).alias("style"))
    n = F.row_number().over(Window.orderBy("source", "doc_id", F.desc("style")))  # a few seeds a source
    return two.select(F.concat(F.lit("R1-"), F.lpad(n.cast("string"), 3, "0")).alias("case_id"), F.concat("style", F.lit(" question on "), F.col("doc_id").cast("string")).alias("question"), "doc_id")


@query("I3 I4", """WITH t AS (SELECT conv_id, turn, replace(replace(text, '. ', '。 '), ', ', '；') AS t FROM conversations),
a AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(replace(t, chr(10), chr(1)), '([。！？；!?;])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM t),
b AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(t, '([。！？；])', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS s FROM t)
SELECT a.conv_id, a.turn, md5(array_to_string(a.s, '|')) AS split, md5(array_to_string(b.s, '|')) AS judged FROM a JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def cjk_sentences(spark, sf_dir):
    """Sentences for splitting, which end at a newline and at ASCII marks too, and for judging, which don't."""
    t = F.replace(F.replace("text", F.lit(". "), F.lit("。 ")), F.lit(", "), F.lit("；"))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    digest = lambda x: F.md5(F.array_join(x, "|"))
    return c.select("conv_id", "turn", digest(X.sentences(F.col("t"), "。！？；!?;", newline=True)).alias("split"), digest(X.sentences(F.col("t"))).alias("judged"))


@query("E8", """WITH k AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '无理由退货' WHEN 1 THEN '的是退款' WHEN 2 THEN '了' WHEN 3 THEN '款 7.5 Days' ELSE '商品的了' END AS t FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN '无理|理由|由退|退货' WHEN 1 THEN '是退|退款' WHEN 2 THEN '' WHEN 3 THEN '7.5|days|款' ELSE '品的|商品' END AS terms FROM k""")
def term_sets(spark, sf_dir):
    k = F.col("p_partkey")
    t = F.when(k % 5 == 0, "无理由退货").when(k % 5 == 1, "的是退款").when(k % 5 == 2, "了").when(k % 5 == 3, "款 7.5 Days").otherwise("商品的了")
    return load(spark, sf_dir, "part").select(k.alias("k"), F.array_join(F.array_sort(X.terms(t)), "|").alias("terms"))


@query("ST8", "SELECT user_id, count(*) AS n FROM events WHERE CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 6) AS INTEGER) % 100 < 20 GROUP BY 1")
def trace_sample(spark, sf_dir):
    """A fifth of the users' events, chosen by the user's hash."""
    share = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 6), 16, 10).cast("int") % 100
    return load(spark, sf_dir, "events").filter(share < 20).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("C18 F13", """WITH d AS (SELECT doc_id, source, length(text) AS n FROM documents), best AS (SELECT source, max(n * 1000000000 + doc_id) % 1000000000 AS doc_id FROM d GROUP BY 1)
SELECT a.source AS left_source, b.source AS right_source, a.doc_id AS left_id, b.doc_id AS right_id FROM best a JOIN best b ON CAST(substr(a.source, 4) AS INTEGER) + 1 = CAST(substr(b.source, 4) AS INTEGER)""")
def pair_picking(spark, sf_dir):
    best = load(spark, sf_dir, "documents").groupBy("source").agg(F.max(F.struct(F.length("text").alias("n"), "doc_id"))["doc_id"].alias("doc_id"))
    k = lambda c: F.substring(c, 4, 10).cast("int")
    a = best.select(F.col("source").alias("left_source"), F.col("doc_id").alias("left_id"), (k("source") + 1).alias("k"))
    b = best.select(F.col("source").alias("right_source"), F.col("doc_id").alias("right_id"), k("source").alias("k"))
    return a.join(b, "k").drop("k")


@query("H2 H3 H4", """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
h AS (SELECT doc_id, line, 1 + (doc_id + line // 2) % 3 AS level, 't' || (doc_id + line // 4) % 5 AS title FROM l WHERE line % 2 = 0),
s AS (SELECT h.doc_id, h.line, (SELECT list(x.title ORDER BY x.level) FROM h x WHERE x.doc_id = h.doc_id AND x.line <= h.line AND x.level > 1 AND NOT EXISTS (SELECT 1 FROM h y WHERE y.doc_id = h.doc_id AND y.line > x.line AND y.line <= h.line AND y.level <= x.level)) AS path FROM h),
n AS (SELECT *, path[1] AS top, lag(path[1]) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM s),
p AS (SELECT *, sum(CASE WHEN top = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS parent_seq FROM n)
SELECT doc_id, line, coalesce(array_to_string(path, ' > '), '') AS path, parent_seq, row_number() OVER (PARTITION BY doc_id, parent_seq ORDER BY line) - 1 AS idx FROM p""")
def heading_islands(spark, sf_dir):
    """Headings (here every second line) with their path: of each level the last one that no higher or equal one followed;
    runs of one top heading as parents, those without one alone, and the rows numbered inside."""
    k, order = F.col("doc_id") + F.floor(F.col("line") / 2), Window.partitionBy("doc_id").orderBy("line")
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).filter("line % 2 = 0")
    h = lines.select("doc_id", "line", (1 + k % 3).alias("level"), F.concat(F.lit("t"), ((F.col("doc_id") + F.floor(F.col("line") / 4)) % 5).cast("string")).alias("title"))
    last = lambda n: F.max(F.when(F.col("level") == n, F.struct("line", "title"))).over(order)
    h = h.select("*", *(last(n).alias(f"l{n}") for n in (1, 2, 3)))
    at = lambda n: F.coalesce(F.col(f"l{n}.line"), F.lit(-1))
    path = F.array_compact(F.array(F.when(at(2) > at(1), F.col("l2.title")), F.when(at(3) > F.greatest(at(1), at(2)), F.col("l3.title"))))
    s = h.select("doc_id", "line", path.alias("path")).withColumn("top", F.get("path", F.lit(0)))
    same = F.coalesce(F.col("top") == F.lag("top").over(order), F.lit(False))
    p = s.withColumn("same", same).withColumn("parent_seq", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order) - 1)
    return p.select("doc_id", F.col("line").cast("long").alias("line"), F.array_join("path", " > ").alias("path"), "parent_seq", (F.row_number().over(Window.partitionBy("doc_id", "parent_seq").orderBy("line")) - 1).cast("long").alias("idx"))


@query("I3 L1", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([。！？；!?;.])', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(length(regexp_replace(s, '[\s\x0b\x1c-\x1f]+', '', 'g'))) AS BIGINT) AS chars FROM s WHERE regexp_replace(s, '[\s\x0b\x1c-\x1f]+', '', 'g') <> '' GROUP BY 1""")
def sentences_lateral(spark, sf_dir):
    """Sentences by a table function in SQL, a row each."""
    tables.register(spark)
    docs = load(spark, sf_dir, "documents")
    return spark.sql(r"""SELECT doc_id, count(*) AS n, sum(length(regexp_replace(sentence, r'(?U)[\s\x1c-\x1f]+', ''))) AS chars FROM {docs} AS d, LATERAL text_sentences(d.text, '。！？；!?;.')
        WHERE regexp_replace(sentence, r'(?U)[\s\x1c-\x1f]+', '') <> '' GROUP BY doc_id""", docs=docs)


@query("I2 H3", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
k AS (SELECT *, CASE WHEN trim(t, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '' THEN '' WHEN starts_with(ltrim(t), '|') THEN 'table' ELSE 'text' END AS kind FROM l),
g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, kind ORDER BY line) AS island FROM k),
b AS (SELECT doc_id, kind, min(line) AS first_line, count(*) AS n_lines FROM g WHERE kind <> '' GROUP BY doc_id, kind, island)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS block, kind, first_line, n_lines FROM b""")
def blocks_partitioned(spark, sf_dir):
    """Blocks of each document's lines by a table function that reads them in order, a partition a document."""
    tables.register(spark)
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return spark.sql("SELECT * FROM line_blocks(TABLE(SELECT doc_id, line, text FROM {lines}) PARTITION BY doc_id ORDER BY line)", lines=lines)


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{2,}}|[0-9]+'))"
_CHUNKS_SQL = _POOL_SQL.split("pool AS")[0].rstrip().rstrip(",")


@query("C18 F13 E9", _CHUNKS_SQL + f""",
usable AS (SELECT doc_id, source, {_WORDS.format("body")} AS terms, {_WORDS.format("path")} AS path FROM chunks
  WHERE length(trim(body, ' ' || chr(9) || chr(10) || chr(13))) >= 30 AND NOT (length(trim(body, ' ' || chr(9) || chr(10) || chr(13))) < 80 AND ends_with(trim(body, ' ' || chr(9) || chr(10) || chr(13)), '：')) AND trim(path) <> '' AND NOT starts_with(path, '相关文件')),
names AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
sides AS (SELECT item_id, side, source, {_WORDS.format("CASE side WHEN 0 THEN left(text, 80) ELSE right(text, 80) END || ' ' || source || ' en'")} AS want
  FROM benchmark, range(2) r(side), names WHERE k = CASE side WHEN 0 THEN item_id % n ELSE (item_id * 7 + 3) % n END),
scored AS (SELECT item_id, side, doc_id, 3 * len(list_intersect(want, path)) + len(list_intersect(want, terms)) AS hit FROM sides JOIN usable USING (source)),
best AS (SELECT item_id, side, max(hit) AS hit, max(hit * 1000000000 + doc_id) % 1000000000 AS doc_id FROM scored GROUP BY 1, 2)
SELECT a.item_id AS topic, a.doc_id AS left_id, b.doc_id AS right_id, a.hit AS left_hit, b.hit AS right_hit FROM best a JOIN best b ON a.item_id = b.item_id AND a.side = 0 AND b.side = 1""")
def topic_pairs(spark, sf_dir):
    """For each topic the chunk of each of its two named documents that fits its keywords best, terms of the path three
    times; ties by the larger id. A document without any fitting chunk gives its last usable one. Chunks meet keywords by
    the terms they share, not by comparing each with each."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}|[0-9]+"), F.lit(0)))
    d = load(spark, sf_dir, "documents")
    c = d.select(
        "doc_id", "source", F.when(F.col("doc_id") % 23 == 0, F.concat(F.substring("text", 1, 60), F.lit("："))).otherwise(F.col("text")).alias("body"),
        F.when(F.col("doc_id") % 17 == 0, "").when(F.col("doc_id") % 19 == 0, "相关文件 > x").otherwise(F.concat_ws(" > ", "source", "lang")).alias("path"),
    ).filter(usable(F.col("body"), F.col("path")))
    names = d.select("source").filter("source is not null").distinct().withColumn("k", F.row_number().over(Window.orderBy("source")) - 1)  # documents' names, a short list
    names = kept(names.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))), "names")
    b = load(spark, sf_dir, "benchmark").crossJoin(F.broadcast(names.select("n").limit(1))).select("item_id", "text", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    at = F.when(F.col("side") == 0, F.col("item_id") % F.col("n")).otherwise((F.col("item_id") * 7 + 3) % F.col("n"))
    sides = b.withColumn("k", at.cast("int")).join(names.select("source", "k"), "k")
    part = F.when(F.col("side") == 0, F.left("text", F.lit(80))).otherwise(F.right("text", F.lit(80)))
    want = kept(sides.select("item_id", "side", "source", F.explode(words(F.concat_ws(" ", part, "source", F.lit("en")))).alias("term")), "keywords")
    terms = c.select("doc_id", "source", F.explode(words(F.col("body"))).alias("term"), F.lit(1).alias("weight")).union(c.select("doc_id", "source", F.explode(words(F.col("path"))).alias("term"), F.lit(3).alias("weight")))
    hits = terms.join(F.broadcast(want) if want.count() <= 500_000 else want, ["source", "term"]).groupBy("item_id", "side", "doc_id").agg(F.sum("weight").alias("hit"))
    last = c.groupBy("source").agg(F.max("doc_id").alias("doc_id")).join(sides.select("item_id", "side", "source"), "source").select("item_id", "side", "doc_id", F.lit(0).cast("long").alias("hit"))
    best = hits.unionByName(last).groupBy("item_id", "side").agg(F.max(F.struct("hit", "doc_id")).alias("m"))
    both = best.groupBy("item_id").agg(*(F.max(F.when(F.col("side") == i, F.col("m"))).alias(name) for i, name in enumerate(("l", "r")))).filter("l is not null and r is not null")
    return both.select(F.col("item_id").alias("topic"), F.col("l.doc_id").alias("left_id"), F.col("r.doc_id").alias("right_id"), F.col("l.hit").alias("left_hit"), F.col("r.hit").alias("right_hit"))

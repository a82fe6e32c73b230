"""Ranking metrics, judge statistics and run summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evistra.plans.retrieval import _BM25_SQL, nearest_texts
from evistra.registry import query
from evistra.sources.facades import load
from evistra.sources.shared import kept


def rank_metrics(cases):
    """cases (case_id, source, candidates, evidence) with candidate_hit, hit1, hit4, mrr by the deepest source's rank;
    a missing source counts as not found, and cases without a source have no metrics."""
    deepest = lambda ranked: F.when(F.exists("source", lambda s: F.array_position(ranked, s) == 0), F.lit(None)).otherwise(F.array_max(F.transform("source", lambda s: F.array_position(ranked, s))))
    c, e = deepest(F.col("candidates")), deepest(F.col("evidence"))
    has = F.size("source") > 0
    one = lambda cond: F.when(has, F.coalesce(cond, F.lit(False)).cast("int"))
    return cases.select(
        "case_id", one(c.isNotNull()).alias("candidate_hit"), one(e <= 1).alias("hit1"), one(e <= 4).alias("hit4"),
        F.when(has, F.round(F.coalesce(1.0 / e, F.lit(0.0)), 6)).alias("mrr"),
    )


_CASES_SQL = f"""WITH {_BM25_SQL},
top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 18),
src AS (SELECT query_id, doc_id, rank FROM top WHERE doc_id % 5 = query_id % 5 UNION ALL SELECT DISTINCT query_id, -1, 999 FROM top WHERE query_id % 4 = 0),
met AS (SELECT q.query_id AS case_id, q.n AS n_source, q.deep FROM (SELECT t.query_id, count(s.doc_id) AS n, max(s.rank) AS deep FROM (SELECT DISTINCT query_id FROM top) t LEFT JOIN src s USING (query_id) GROUP BY 1) q),
metrics AS (SELECT case_id, CASE WHEN n_source > 0 THEN CASE WHEN deep <= 18 THEN 1 ELSE 0 END END AS candidate_hit, CASE WHEN n_source > 0 THEN CASE WHEN deep <= 1 THEN 1 ELSE 0 END END AS hit1,
  CASE WHEN n_source > 0 THEN CASE WHEN deep <= 4 THEN 1 ELSE 0 END END AS hit4, CASE WHEN n_source > 0 THEN CASE WHEN deep <= 8 THEN round(1.0 / deep, 6) ELSE 0 END END AS mrr FROM met)
"""


def _metrics(spark, sf_dir):
    return rank_metrics(_cases(spark, sf_dir))


def _cases(spark, sf_dir):
    top = nearest_texts(spark, sf_dir)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    c = top.groupBy(F.col("query_id").alias("case_id")).agg(ids.alias("candidates"))
    source = F.filter("candidates", lambda d: d % 5 == F.col("case_id") % 5)
    missing = F.when(F.col("case_id") % 4 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return kept(c.select("case_id", F.concat(source, missing).alias("source"), "candidates", F.slice("candidates", 1, 8).alias("evidence")), "cases")


@query("L11 F11", _CASES_SQL + "SELECT * FROM metrics")
def retrieval_rank_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query("D-11 D-12 I15", _CASES_SQL + """, keyed AS (SELECT t.query_id AS case_id, coalesce(string_agg(DISTINCT CASE WHEN s.doc_id < 0 THEN 'gone' ELSE 'D' || (s.doc_id // 40) END, '+' ORDER BY CASE WHEN s.doc_id < 0 THEN 'gone' ELSE 'D' || (s.doc_id // 40) END), '-') AS doc
  FROM (SELECT DISTINCT query_id FROM top) t LEFT JOIN src s ON t.query_id = s.query_id GROUP BY 1)
SELECT doc, count(*) AS n, count(mrr) AS counted, round(avg(hit4), 6) AS hit4, round(avg(mrr), 6) AS mrr FROM metrics JOIN keyed ON metrics.case_id = keyed.case_id GROUP BY 1""")
def metric_breakdown(spark, sf_dir):
    """Means by the documents that a case's sources belong to, those of several joined in order; cases without are -."""
    ids = F.transform("source", lambda s: F.when(s < 0, "gone#0").otherwise(F.format_string("D%d#%d", F.floor(s / 40).cast("long"), s)))
    doc = F.array_join(F.array_sort(F.array_distinct(F.transform(ids, lambda s: F.substring_index(s, "#", 1)))), "+")
    c = _cases(spark, sf_dir)
    m = rank_metrics(c).join(c.select("case_id", F.when(F.size("source") == 0, "-").otherwise(doc).alias("doc")), "case_id")
    return m.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count("mrr").alias("counted"), F.round(F.avg("hit4"), 6).alias("hit4"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query("B11 I23", _CASES_SQL + "SELECT case_id, CASE WHEN candidate_hit IS NULL THEN 'no source' WHEN candidate_hit = 0 THEN 'not recalled' WHEN hit4 = 0 THEN 'stuck' ELSE 'found' END AS diagnosis FROM metrics")
def stuck_cases(spark, sf_dir):
    d = F.when(F.col("candidate_hit").isNull(), "no source").when(F.col("candidate_hit") == 0, "not recalled").when(F.col("hit4") == 0, "stuck").otherwise("found")
    return _metrics(spark, sf_dir).select("case_id", d.alias("diagnosis"))


@query("D-16", _CASES_SQL + """SELECT CASE WHEN mrr < 0.001 THEN 0 WHEN mrr < 0.34 THEN 1 WHEN mrr < 0.67 THEN 2 WHEN mrr < 0.999 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM metrics WHERE mrr IS NOT NULL GROUP BY 1""")
def score_histogram(spark, sf_dir):
    b = F.lit(4)
    for i, edge in reversed(list(enumerate((0.001, 0.34, 0.67, 0.999)))):
        b = F.when(F.col("mrr") < edge, i).otherwise(b)
    return _metrics(spark, sf_dir).filter("mrr is not null").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- judges: two rounds of verdicts on each labelled document; a case is a source and ten ids --------------------------

_VERDICTS_SQL = """WITH v AS (SELECT source || '-' || (l.doc_id // 50) AS case_id, l.doc_id, quality, 1 - toxic AS second FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
pos AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) AS pos FROM v)
"""


def _verdicts(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    v = load(spark, sf_dir, "labels").join(d, "doc_id").withColumn("case_id", F.concat("source", F.lit("-"), F.expr("doc_id div 50").cast("string")))
    return v.select("case_id", "doc_id", "quality", (1 - F.col("toxic")).alias("second"), F.row_number().over(Window.partitionBy("case_id").orderBy("doc_id")).alias("pos"))


@query("D-20 H13", _VERDICTS_SQL + """, run AS (SELECT case_id, pos, quality, sum(quality) OVER (PARTITION BY case_id ORDER BY pos) AS hits FROM pos)
SELECT case_id, count(*) AS n, round(coalesce(sum(quality * hits * 1.0 / pos) / nullif(sum(quality), 0), 0), 6) AS ap FROM run GROUP BY 1""")
def average_precision(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    hits = F.sum("quality").over(Window.partitionBy("case_id").orderBy("pos"))
    run = v.withColumn("p", F.col("quality") * hits / F.col("pos"))
    return run.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("p") / F.nullif(F.sum("quality"), F.lit(0)), F.lit(0.0)), 6).alias("ap"))


@query("D-21", _VERDICTS_SQL + "SELECT case_id, round(avg(quality), 6) AS recall FROM pos GROUP BY 1")
def support_recall(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("case_id").agg(F.round(F.avg("quality"), 6).alias("recall"))


@query("C10 D-21", _VERDICTS_SQL + """, said AS (SELECT case_id, pos, second AS hit, pos % 3 AS late FROM pos WHERE pos % 4 <> 0 UNION ALL SELECT case_id, pos, quality, 9 FROM pos WHERE pos % 5 = 1),
last AS (SELECT case_id, pos, hit FROM said QUALIFY row_number() OVER (PARTITION BY case_id, pos ORDER BY late DESC) = 1)
SELECT pos.case_id, count(*) AS n, round(avg(coalesce(hit, 0)), 6) AS recall FROM pos LEFT JOIN last ON pos.case_id = last.case_id AND pos.pos = last.pos GROUP BY 1""")
def judged_support(spark, sf_dir):
    """A judge's verdicts matched to the units by number: the last of several counts, a missing one is a miss."""
    units = _verdicts(spark, sf_dir)
    said = units.filter("pos % 4 <> 0").select("case_id", "pos", F.col("second").alias("hit"), (F.col("pos") % 3).alias("at")).union(units.filter("pos % 5 = 1").select("case_id", "pos", "quality", F.lit(9)))
    last = said.groupBy("case_id", "pos").agg(F.max_by("hit", "at").alias("hit"))
    return units.join(last, ["case_id", "pos"], "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


@query("L12", _CASES_SQL + """, run AS (SELECT *, case_id % 11 = 0 AS failed, case_id % 6 = 0 AS empty FROM metrics)
SELECT count(*) AS n, count_if(failed) AS failures, count_if(empty AND NOT failed) AS retrieval_errors, round(avg(CASE WHEN empty THEN CASE WHEN mrr IS NOT NULL THEN 0 END ELSE mrr END) FILTER (NOT failed), 6) AS mrr FROM run""")
def run_accounting(spark, sf_dir):
    """A case whose search failed counts with zeros; one whose run failed has no scores and is counted apart."""
    r = _metrics(spark, sf_dir).withColumn("failed", F.col("case_id") % 11 == 0).withColumn("empty", F.col("case_id") % 6 == 0)
    mrr = F.when(~F.col("failed"), F.when(F.col("empty") & F.col("mrr").isNotNull(), 0.0).otherwise(F.col("mrr")))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"), F.count_if(F.col("empty") & ~F.col("failed")).alias("retrieval_errors"), F.round(F.avg(mrr), 6).alias("mrr"))


@query("D-18 C19", _VERDICTS_SQL + "SELECT count(*) AS positions, count_if(quality <> second) AS flipped, round(count_if(quality <> second) * 1.0 / count(*), 6) AS flip_rate FROM pos")
def judge_flip_rate(spark, sf_dir):
    rounds = _rounds(spark, sf_dir).groupBy("case_id", "pos").agg(F.count_distinct("hit").alias("k"))
    return rounds.agg(F.count(F.lit(1)).alias("positions"), F.count_if(F.col("k") > 1).alias("flipped")).withColumn("flip_rate", F.round(F.col("flipped") / F.col("positions"), 6))


_CUT_SQL = _VERDICTS_SQL.rstrip() + """,
long AS (SELECT case_id, 'a' AS round, pos, quality AS hit FROM pos UNION ALL SELECT case_id, 'b', pos, second FROM pos WHERE pos % 5 <> 0 OR length(case_id) % 2 = 0 UNION ALL SELECT case_id, 'c', pos, quality FROM pos WHERE doc_id % 4 <> 1),
placed AS (SELECT case_id, round, hit, row_number() OVER (PARTITION BY case_id, round ORDER BY pos) AS pos, count(*) OVER (PARTITION BY case_id, round) AS n FROM long),
shortest AS (SELECT case_id, min(n) AS n, count(DISTINCT round) AS rounds FROM placed GROUP BY 1)"""


@query("C19 D-18", _CUT_SQL + """ SELECT case_id, count(*) AS positions, count_if(k > 1) AS flipped FROM (SELECT p.case_id, pos, count(DISTINCT hit) AS k FROM placed p JOIN shortest s ON p.case_id = s.case_id AND pos <= s.n AND s.rounds = 3 GROUP BY 1, 2) GROUP BY 1""")
def judge_flips_aligned(spark, sf_dir):
    """Flips of cases whose rounds judged different numbers of units: aligned by position, cut to the shortest round."""
    v = _verdicts(spark, sf_dir)
    b = v.filter((F.col("pos") % 5 != 0) | (F.length("case_id") % 2 == 0))
    rows = v.select("case_id", F.lit("a").alias("round"), "pos", F.col("quality").alias("hit")).union(b.select("case_id", F.lit("b"), "pos", "second")).union(v.filter("doc_id % 4 <> 1").select("case_id", F.lit("c"), "pos", "quality"))
    return aligned_flips(rows, 3)


def aligned_flips(rows, rounds: int):
    """(case_id, positions, flipped) of (case_id, round, pos, hit): units by their order within a round, up to the length of
    the case's shortest round; a case without all its rounds has none."""
    by = Window.partitionBy("case_id", "round")
    placed = rows.select("case_id", "round", "hit", F.row_number().over(by.orderBy("pos")).alias("pos"), F.count(F.lit(1)).over(by).alias("n"))
    shortest = placed.groupBy("case_id").agg(F.min("n").alias("least"), F.count_distinct("round").alias("rounds")).filter(F.col("rounds") == rounds)
    units = placed.join(shortest, "case_id").filter(F.col("pos") <= F.col("least")).groupBy("case_id", "pos").agg(F.count_distinct("hit").alias("k"))
    return units.groupBy("case_id").agg(F.count(F.lit(1)).alias("positions"), F.count_if(F.col("k") > 1).alias("flipped"))


def _rounds(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select("case_id", "pos", F.explode(F.create_map(F.lit("a"), "quality", F.lit("b"), "second")).alias("round", "hit"))


_ROUNDS_SQL = _VERDICTS_SQL + ", r AS (SELECT case_id, pos, 'a' AS round, quality AS hit FROM pos UNION ALL SELECT case_id, pos, 'b', second FROM pos)"


@query("D-17 I12", _ROUNDS_SQL + ", m AS (SELECT round, round(avg(hit), 3) AS mean FROM r GROUP BY 1) SELECT round(avg(mean), 6) AS mean, round(max(mean) - min(mean), 6) AS spread, count(*) AS rounds FROM m")
def judge_spread(spark, sf_dir):
    m = _rounds(spark, sf_dir).groupBy("round").agg(F.round(F.avg("hit"), 3).alias("mean"))
    return m.agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.max("mean") - F.min("mean"), 6).alias("spread"), F.count(F.lit(1)).alias("rounds"))


@query("D-19", _ROUNDS_SQL + ", m AS (SELECT case_id, round, avg(hit) AS score FROM r GROUP BY 1, 2) SELECT case_id, round(max(score) - min(score), 6) AS spread FROM m GROUP BY 1 HAVING max(score) > min(score)")
def unstable_cases(spark, sf_dir):
    m = _rounds(spark, sf_dir).groupBy("case_id", "round").agg(F.avg("hit").alias("score"))
    return m.groupBy("case_id").agg(F.round(F.max("score") - F.min("score"), 6).alias("spread")).filter("spread > 0")


@query("L15", _ROUNDS_SQL + ", a AS (SELECT case_id, min(hit) = 1 AS pass FROM r WHERE round = 'a' GROUP BY 1), b AS (SELECT case_id, min(hit) = 1 AS pass FROM r WHERE round = 'b' GROUP BY 1) SELECT coalesce(a.case_id, b.case_id) AS case_id, a.pass AS pass_a, b.pass AS pass_b, coalesce(a.pass AND NOT b.pass, false) AS regressed FROM a FULL JOIN b ON a.case_id = b.case_id")
def version_compare(spark, sf_dir):
    p = lambda r: _rounds(spark, sf_dir).filter(F.col("round") == r).groupBy("case_id").agg((F.min("hit") == 1).alias(f"pass_{r}"))
    both = p("a").join(p("b"), "case_id", "full")
    return both.withColumn("regressed", F.coalesce(F.col("pass_a") & ~F.col("pass_b"), F.lit(False)))


@query("D-14", _ROUNDS_SQL + "SELECT case_id, bool_and(hit = 1) AS hard, round(avg(hit), 6) AS soft, len(list(pos ORDER BY pos) FILTER (hit = 0)[1:3]) AS shown FROM r GROUP BY 1")
def case_scores(spark, sf_dir):
    failed = F.slice(F.array_sort(F.collect_list(F.when(F.col("hit") == 0, F.col("pos")))), 1, 3)
    out = _rounds(spark, sf_dir).groupBy("case_id").agg(F.bool_and(F.col("hit") == 1).alias("hard"), F.round(F.avg("hit"), 6).alias("soft"), failed.alias("f"))
    return out.select("case_id", "hard", "soft", F.when(F.size("f") > 0, F.size("f")).cast("long").alias("shown"))


@query("D-13 B7 D-25", _ROUNDS_SQL + ", c AS (SELECT case_id, min(hit) AS pass, count(*) % 4 = 0 AS p0 FROM r GROUP BY 1) SELECT count(*) AS n, coalesce(round(avg(pass), 6), 0) AS pass_rate, coalesce(round(avg(pass) FILTER (p0), 6), 0) AS p0_rate, count_if(pass = 1) AS passed FROM c")
def run_summary(spark, sf_dir):
    c = _rounds(spark, sf_dir).groupBy("case_id").agg(F.min("hit").alias("pass"), (F.count(F.lit(1)) % 4 == 0).alias("p0"))
    rate = lambda x: F.coalesce(F.round(F.avg(x), 6), F.lit(0.0))
    return c.agg(F.count(F.lit(1)).alias("n"), rate(F.col("pass")).alias("pass_rate"), rate(F.when(F.col("p0"), F.col("pass"))).alias("p0_rate"), F.count_if(F.col("pass") == 1).alias("passed"))

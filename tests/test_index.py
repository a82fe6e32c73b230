"""Chinese analysis against all cuts, and the index against a scan of all texts."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evistra.operators import analysis as A
from evistra.operators import index as I
from evistra.operators import retrieval as R
from evistra.sources import shared as S

WORDS = [("退货", 60), ("货物", 20), ("退", 5), ("物流", 30), ("流程", 25), ("七天", 40), ("无理由", 35), ("无", 4), ("理由", 30), ("商品", 50), ("完好", 20), ("的", 90)]


@pytest.fixture(scope="module")
def lexicon(spark):
    return A.lexicon(spark.createDataFrame(WORDS, "word string, n long"))


def cuts(run):
    if not run:
        yield []
    for k in range(1, min(A.LONGEST, len(run)) + 1):
        for rest in cuts(run[k:]):
            yield [run[:k], *rest]


def test_best_path_is_the_best_of_all_cuts(lexicon):
    weights = {r.word: r.weight for r in lexicon.collect()}
    least = weights.pop(None)
    pick = random.Random(5)
    for _ in range(60):
        run = "".join(pick.choice([w for w, _ in WORDS] + ["龙", "的"]) for _ in range(4))[:9]
        known = [c for c in cuts(run) if all(len(w) == 1 or w in weights for w in c)]
        want = max(known, key=lambda c: (sum(weights.get(w, least) for w in c), [len(w) for w in c]))
        assert A.best_path(run, weights, least) == want


def test_words_inside_sentences_are_terms(spark, lexicon):
    rows = [(1, "本店支持七天无理由退货。商品完好"), (2, "物流流程 Abc12，退货物流"), (3, None), (4, ""), (5, "no ideographs here")]
    got = {r.doc_id: r.t for r in spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", A.analyzer(lexicon)(F.col("text")).alias("t")).collect()}
    assert got[1] == ["本", "店", "支", "持", "七天", "无理由", "退货", "商品", "完好"]
    assert got[2] == ["物流", "流程", "abc12", "退货", "物流"]
    assert got[3] == got[4] == [] and got[5] == ["no", "ideographs", "here"]


def test_search_finds_words_inside_sentences(spark, lexicon):
    docs = spark.createDataFrame([(1, "本店支持七天无理由退货。"), (2, "物流很快的"), (3, "商品完好的时候可以退货")], "doc_id long, text string")
    analyze = A.analyzer(lexicon)
    asked = spark.createDataFrame([(1, "怎么退货"), (2, "物流流程")], "query_id long, text string")
    got = [(r.query_id, r.doc_id, r["rank"]) for r in I.search(I.build(docs, analyze), asked, 5, analyze=analyze).rows.orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 3, 2), (2, 2, 1)]


@pytest.mark.parametrize("segment", [2, 16])
def test_index_gives_the_rows_of_a_full_scan(spark, monkeypatch, segment):
    """By groups, with a condition and a k of each query's own; null and empty texts; ties by the smaller id."""
    monkeypatch.setattr(I, "SEGMENT", segment)
    monkeypatch.setattr(I, "FIRST", 1)
    pick = random.Random(segment)
    word = lambda: f"w{min(pick.randrange(40), pick.randrange(40))}"
    rows = [(i, ("law", "platform", None)[i % 3], i % 5, " ".join(word() for _ in range(pick.randrange(1, 25)))) for i in range(150)] + [(200, "law", 1, None), (201, "law", 1, ""), (202, "law", 1, rows_tie := "w1 w2"), (203, "law", 1, rows_tie)]
    docs = spark.createDataFrame(rows, "doc_id long, layer string, day int, text string")
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(4)), 1 + q % 4) for q in range(8)] + [(90, None, 3), (91, "unknown", 3)], "query_id long, text string, k int")
    found = I.search(I.build(docs, group="layer"), asked, F.col("k"), live=F.col("day") < 4, most=4)
    scan = R.bm25_scores(asked.select("query_id", "text"), docs).join(docs.filter("day < 4").select("doc_id", F.coalesce("layer", F.lit("")).alias("grp")), "doc_id").join(asked.select("query_id", "k"), "query_id")
    want = R.top_k(scan, ["query_id", "grp"], F.col("k"), "doc_id")
    rows_of = lambda df: sorted((r.query_id, r.grp, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert rows_of(found.rows) == rows_of(want)
    heads = found.heads.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("read").cast("int")).alias("read")).first()
    assert 0 < heads["read"] <= heads["n"] and (segment > 2 or heads["read"] < heads["n"])


def rows_written(folder):
    return sum(pq.read_metadata(f).num_rows for f in folder.rglob("*.parquet"))


@pytest.mark.parametrize(("equal", "most"), [(False, 8_000), (True, 500)])
def test_search_writes_no_pairs_of_texts_and_segments(spark, tmp_path, monkeypatch, equal, most):
    """Every text meets every segment; what is kept on the way follows the texts, those that are equal counting once."""
    docs = spark.range(3200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), F.concat(F.lit("w"), F.col("id") % 97)).alias("text"))
    own = F.lit(0) if equal else F.col("id") % 97
    asked = spark.range(400).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("a"), F.concat(F.lit("w"), own), F.lit("q") if equal else F.concat(F.lit("q"), "id")).alias("text"))
    index = I.build(docs)
    monkeypatch.setattr(S, "shared_dir", lambda spark: str(tmp_path))
    found = I.search(index, asked, 3).rows.collect()
    assert len(found) == 1200 and {(r.query_id, r["rank"], r.doc_id) for r in found if r.query_id == 0} == {(0, 1, 0), (0, 2, 97), (0, 3, 194)}
    assert rows_written(tmp_path) < most


def test_postings_are_not_shuffled(spark):
    """The only exchange of a search's last step comes after each task's best rows were taken."""
    docs = spark.createDataFrame([(i, f"a w{i % 5}") for i in range(200)], "doc_id long, text string")
    found = I.search(I.build(docs), spark.createDataFrame([(1, "a w1")], "query_id long, text string"), 3)
    for df in (found.rows, found.heads):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("MapInArrow") :].split("BroadcastExchange")[0]


@pytest.mark.parametrize("turns", ["TEXTS", "TERM_ROWS"])
def test_texts_in_turns_give_the_same_rows(spark, monkeypatch, turns):
    pick = random.Random(3)
    text = lambda n: " ".join(f"w{min(pick.randrange(30), pick.randrange(30))}" for _ in range(n))
    docs = spark.createDataFrame([(i, text(9)) for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, text(3)) for q in range(12)], "query_id long, text string")
    index = I.build(docs)
    got = lambda s: (sorted(map(tuple, s.rows.collect())), sorted(map(tuple, s.heads.collect())))
    once = got(I.search(index, asked, 4))
    monkeypatch.setattr(*((I, "TEXTS", 5) if turns == "TEXTS" else (R, "TERM_ROWS", 15)))
    assert got(I.search(index, asked, 4)) == once


def test_index_of_no_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert I.search(I.build(none), asked, 3).rows.count() == 0


def test_limits_reach_below_the_shuffle(spark):
    rows = spark.createDataFrame([(1, 2, 1.0, 3)], "query_id long, doc_id long, score double, k int")
    plan = R.top_k(rows, ["query_id"], F.col("k"), "doc_id", R.MOST_K)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan

"""Operators and readers on small inputs of their own."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evistra.functions import text as X
from evistra.operators import chunking, decision
from evistra.operators import retrieval as R
from evistra.operators import scoring as S
from evistra.operators.semantic import semantic_chunks
from evistra.operators.stats import nearest_rank
from evistra.sources import readers


@pytest.mark.parametrize("block", [1024, 3])
def test_dense_search_is_exact_in_blocks(spark, monkeypatch, block):
    """Every sub-query against every chunk, ties by the smaller id; vectors of another length or none are left out."""
    monkeypatch.setattr(R, "QUERY_BLOCK", block)
    monkeypatch.setattr(R, "ROW_SLICE", 7)
    r = np.random.default_rng(2)
    chunks = [(i, ("law", "platform")[i % 2], [float(x) for x in r.integers(-2, 3, 4)]) for i in range(40)] + [(90, "law", [1.0]), (91, "law", None)]
    subs = [(q, f"q{q % 2}", [float(x) for x in r.integers(-2, 3, 4)], 3, 5) for q in range(8)]
    c = spark.createDataFrame(chunks, "chunk_id long, layer string, vec array<float>")
    s = spark.createDataFrame(subs, "query_id long, sub_id string, qvec array<float>, k_platform int, k_law int")
    got = sorted((x.query_id, x.layer, x["rank"], x.chunk_id, x.score) for x in R.dense_topk(s, c).collect())
    want = []
    for q, _, v, k_platform, k_law in subs:
        for layer, k in (("platform", k_platform), ("law", k_law)):
            best = sorted((-float(np.dot(v, x)), i) for i, l, x in chunks if l == layer and x and len(x) == 4)[:k]
            want += [(q, layer, n, i, -d) for n, (d, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_dense_search_holds_few_scores_and_shuffles_no_vector(spark, monkeypatch):
    assert R.QUERY_BLOCK * R.ROW_SLICE * 8 <= 16 << 20  # bytes of scores that a task holds at once
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    c = spark.createDataFrame([(i, "law", [1.0, float(i)]) for i in range(20)], "chunk_id long, layer string, vec array<float>")
    s = spark.createDataFrame([(q, "q1", [1.0, 0.5], 3, 5) for q in range(8)], "query_id long, sub_id string, qvec array<float>, k_platform int, k_law int")
    plan = R.dense_topk(s, c)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
    assert plan.index("Join") < plan.index("WindowGroupLimit")  # only the best rows of all tasks meet their sub-queries


def test_markdown_with_frontmatter(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    head = "---\ndoc_id: d1\ntitle: 'A: b'\nlayer: law\neffective_date: 2024-01-01\nexpire_date: 9999-12-31\ntags: [x, , y ]\n---\n"
    (tmp_path / "sub" / "a.md").write_bytes((head + "# One\r\ntext").encode())
    (tmp_path / "README.md").write_text("no frontmatter")
    row = readers.frontmatter(readers.markdown(spark, str(tmp_path))).withColumn("tags", readers.tags(F.col("meta")["tags"])).collect()
    assert len(row) == 1
    assert row[0].meta["title"] == "A: b" and row[0].body == "# One\ntext" and row[0].tags == ["x", "y"]


def test_missing_frontmatter_stops(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ndoc_id: d1\n---\ntext")
    with pytest.raises(Exception, match="lacks title"):
        readers.frontmatter(readers.markdown(spark, str(tmp_path))).collect()


def test_json_sources_and_sink(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"_note": "n", "C1": {"name": "a", "n": 1}, "C2": {"name": "ü", "n": 2}}))
    row = StructType.fromDDL("name string, n int")
    got = readers.json_objects(spark, str(tmp_path / "o.json"), row)
    assert sorted(tuple(r) for r in got.collect()) == [("C1", "a", 1), ("C2", "ü", 2)]
    readers.write_json_lines(got, str(tmp_path / "lines"))
    back = readers.json_lines(spark, str(tmp_path / "lines"), StructType.fromDDL("key string, name string, n int"))
    assert sorted(tuple(r) for r in back.collect()) == [("C1", "a", 1), ("C2", "ü", 2)]
    (tmp_path / "bad.json").write_text('{"key": "C1"}\n{"key": \n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.json"), StructType.fromDDL("key string")).collect()


def test_each_route_keeps_its_share_of_the_candidates(spark):
    """The first route's 30 chunks are found by two paths, the second's 12 by one: all of the first would rank before.
    The third sub-query of the plan found nothing, and its share goes to the rest."""
    rows = [(1, "q1", "law", p, c, 1.0, c) for p in ("bm25", "dense") for c in range(1, 31)] + [(1, "q2", "law", "bm25", 100 + c, 1.0, 60 + c) for c in range(1, 13)]
    ranked = spark.createDataFrame(rows, "query_id long, sub_id string, layer string, path string, chunk_id long, score double, rank int")
    plan = lambda n: spark.createDataFrame([(1, n)], "query_id long, n_routes int")
    got = R.routed_candidates(R.fuse(ranked), plan(2)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [*range(1, 11), *range(101, 111)] and {r.turn for r in got} == {"q1", "q2"}
    got = R.routed_candidates(R.fuse(ranked), plan(3)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [*range(1, 7), *range(101, 107), *range(7, 15)] and [r.turn for r in got].count(None) == 8


def test_each_route_leads_the_evidence(spark):
    rows = [(1, 7, ["q1/law/bm25#1"], 3, 1), (1, 8, ["q1/law/bm25#2", "q2/law/bm25#9"], 3, 2), (1, 9, ["q3/law/dense#4"], 3, 3), (1, 6, ["q1/law/bm25#3"], 3, 0), (2, 5, ["q1/law/bm25#1"], 1, 1), (2, 4, ["q1/law/bm25#2"], 1, 2)]
    e = spark.createDataFrame(rows, "query_id long, chunk_id long, hits array<string>, n_routes int, place int")
    got = [(r.query_id, r.chunk_id) for r in R.routed_evidence(e).orderBy("query_id", "place").collect()]
    assert got == [(1, 6), (1, 8), (1, 9), (1, 7), (2, 5), (2, 4)]


def sections_of(spark, evidence, children, **kwargs):
    e = spark.createDataFrame([(1, i, 1.0 / i, d, p, c, f"path {p}.{c}", f"why {i}") for i, (d, p, c) in enumerate(evidence, 1)], "query_id long, place int, score double, doc string, parent_seq long, chunk_index int, path string, why string")
    c = spark.createDataFrame(children, "doc string, parent_seq long, chunk_index int, n_tokens int, text string")
    return R.assemble(e, c, **kwargs).orderBy("section").collect()


def test_hits_on_one_parent_are_one_section(spark):
    kids = [("P", 1, 0, 5, "a"), ("P", 1, 1, 5, "b"), ("P", 3, 0, 5, "c")]
    got = sections_of(spark, [("P", 1, 0), ("P", 1, 1)], kids)
    assert [(r.text, r.n_tokens, r.label, r.why) for r in got] == [("a\n\nb", 10, "path 1.0", "why 1")]
    assert [r.text for r in sections_of(spark, [("P", 1, 0), ("P", 3, 0)], kids)] == ["a\n\nb", "c"]


def test_neighbours_merge_up_to_three_and_skips_leave_no_trace(spark):
    kids = [(d, p, 0, 1, f"{d}{p}") for d in "PQ" for p in range(1, 10)]
    got = sections_of(spark, [("P", 2, 0), ("P", 1, 0), ("P", 3, 0), ("P", 4, 0), ("Q", 3, 0)], kids)
    assert [(r.label, r.text) for r in got] == [("path 1.0 … path 3.0", "P1\n\nP2\n\nP3"), ("path 4.0", "P4"), ("path 3.0", "Q3")]
    got = sections_of(spark, [("P", 1, 0), ("P", 5, 0), ("P", 2, 0), ("P", 6, 0)], kids, top_k=1)
    assert [r.text for r in got] == ["P1\n\nP2"]


def test_budget_cuts_to_hits_and_then_ends(spark):
    kids = [("P", 1, i, 10, f"t{i}") for i in range(6)] + [("Q", 1, 0, 50, "long"), ("R", 1, 0, 1, "short"), ("S", 1, 0, 1, "same"), ("S", 1, 1, 1, "same")]
    got = sections_of(spark, [("P", 1, 4), ("Q", 1, 0), ("R", 1, 0)], kids, budget=40)
    assert [r.text for r in got] == ["t3\n\nt4\n\nt5"]  # the long one ends the assembly, so the short one doesn't come
    assert [r.repeated for r in sections_of(spark, [("S", 1, 0), ("R", 1, 0)], kids)] == [True, False]


TURN = "tools array<string>, verdicts array<string>, policy array<string>, log array<struct<decision:string,receipt:string,order_id:string,amount:double>>, answer string"


def online(spark, *turn):
    r = S.online_scores(spark.createDataFrame([turn], TURN)).first()
    return r.outcome, r.rule_consistency, r.receipt_in_answer, r.log_structure


def test_online_scores_of_single_turns(spark):
    paid = [("批准", "R9000", "O1", 99.0)]
    assert online(spark, [S.CHECK, S.REFUND], ["通过：可以"], [], paid, "R9000") == ("approved", 1, 1, 1)
    assert online(spark, [S.CHECK, S.REFUND, S.REFUND], ["通过：可以"], [], paid, "编号 D9999") == ("approved", 1, 0, 0)
    assert online(spark, [], [], [], [], "请提供订单号") == ("ask_order_id", 1, 1, 1)
    assert online(spark, [S.CHECK], [], [], [], "不行") == ("clarify", 0, 1, 1)
    assert online(spark, [S.CHECK, S.DENIAL], ["不通过：晚了", "参数错误：x"], [], [("拒绝", "D9001", "O1", 0.0)], "单号 D 9001") == ("denied", 1, 1, 1)
    assert online(spark, [S.CHECK, "handoff_to_human"], ["通过：可以"], [], [], "转人工") == ("handoff", 0, 1, 1)


def test_evidence_is_the_last_receipt_that_is_no_failure_and_no_name(spark):
    profile = "客户 C1（某某）\n会员等级：金牌\n订单"
    rows = [([S.REFUND], [("批准", "R1", "O1", 9.0)], [(S.REFUND, "退款 R1"), (S.REFUND, "操作失败：重复"), (S.DENIAL, "拒绝 D1")], profile), ([S.CHECK], [], [(S.REFUND, "退款 R1")], None)]
    df = spark.createDataFrame(rows, "tools array<string>, log array<struct<decision:string,receipt:string,order_id:string,amount:double>>, results array<struct<tool:string,text:string>>, profile string")
    got = df.select(S.action_evidence(F.col("tools"), F.col("log"), F.col("results")), S.customer_evidence(F.col("profile"))).collect()
    assert [tuple(r) for r in got] == [("退款 R1", "会员等级：金牌\n订单"), ("", "")]


def test_ledger_keeps_to_its_sessions_order(spark):
    rows = [
        ("a", 1, "k", "approve", 1, 7, 5.0), ("a", 2, "k", "deny", 1, 7, 5.0), ("a", 3, "x", "approve", 1, 7, 5.0), ("a", 4, "x", "deny", 1, 7, 5.0), ("a", 5, "", "approve", 2, 9, 5.0), ("a", 6, None, "deny", None, 9, 5.0),
        ("a", 7, "x", "approve", 3, 7, 5.0), ("b", 1, "k", "approve", 1, 7, 5.0), ("b", 2, "", "approve", 3, 7, 5.0),
    ]
    attempts = spark.createDataFrame(rows, "session string, seq int, key string, action string, order_id int, acting_user int, amount double")
    orders = spark.createDataFrame([(1, 7, False), (2, 7, False), (3, 7, True)], "order_id int, customer_id int, refunded boolean")
    got = [(r.session, r.seq, r.status, r.receipt, r.amount) for r in decision.settle(attempts, orders).orderBy("session", "seq").collect()]
    assert [x[2:] for x in got] == [
        ("applied", "R9000", 5.0), ("replayed", "R9000", 5.0), ("refunded", None, None), ("applied", "D9001", 0.0), ("missing", None, None), ("applied", "D9002", 0.0),
        ("replayed", "D9001", 0.0), ("applied", "R9000", 5.0), ("refunded", None, None),
    ]


def plain_chunks(body, far, terminators):
    """(path, kind, text) of a body's chunks, one section and block after the other; far(i) is the i-th distance of a
    long paragraph's sentences."""
    size = chunking.count_tokens
    for path, text in chunking.sections(body):
        held, n = [], 0
        for kind, block in [*chunking.blocks(text), (None, "")]:
            m = size(block)
            long = kind == "text" and m > 512
            if held and (kind is None or long or (kind == "text" and n + m > 320) or (kind != "text" and n + m > 512)):
                yield (path, *chunking.merged(held))
                held, n = [], 0
            if long:
                said = chunking.sentences(block, terminators)
                d = [far(i) for i in range(len(said) - 1)]
                line = sorted(d)[min(int(len(d) * 0.85), len(d) - 1)] if len(said) >= 3 else 9.0
                parts, run = [], ""
                for i, s in enumerate(said):
                    if run and (size(run) + size(s) > 512 or (d[i - 1] >= line and size(run) >= 160)):
                        parts.append(run)
                        run = ""
                    run += s
                for part in [*parts, run]:
                    yield from ((path, "text", t) for t in chunking.hard_split(part))
            elif kind:
                held.append((kind, block))
                n += m
                if kind != "text" and n >= 320:
                    yield (path, *chunking.merged(held))
                    held, n = [], 0


def chunk_rows(spark, bodies, vec=None):
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id string, body string")
    got = chunking.chunk_documents(docs, vec).orderBy("doc_id", "parent_seq", "chunk_index").collect()
    return [[r for r in got if r.doc_id == str(i)] for i in range(len(bodies))]


def test_chunks_of_markdown(spark):
    text = "intro\n\n# Title\n## A\none\n\n~~~\n# not a heading\n```\n~~~\n---\n### B\n| t | u |\n| 1 | 2 |\n\ntwo\n## C\n\n"
    got = chunking.sections(text)
    assert [p for p, _ in got] == [[], ["A"], ["A", "B"]] and got[1][1] == "one\n\n~~~\n# not a heading\n```\n~~~"
    assert chunking.blocks(got[1][1]) == [("text", "one"), ("code", "~~~\n# not a heading\n```\n~~~")]
    assert chunking.sections("a\n- - -\nb\n***") == [([], "a\n- - -\nb")]
    words = lambda n: " ".join(["w"] * n)
    table = lambda n: "| " + " ".join(["w"] * (n - 1))
    bodies = [text, f"{words(200)}\n\n{words(100)}\n\n{words(50)}", f"{words(200)}\n\n{table(300)}\n\n{words(10)}", f"{words(10)}\n\n{words(700)}\n\n{words(10)}", "a\n\n```\nb\n```\n| c", "", None]
    got = [[(r.kind, r.section_path, chunking.count_tokens(r.body)) for r in rows] for rows in chunk_rows(spark, bodies)]
    assert got[0] == [("text", "", 1), ("code", "A", 8), ("table", "A > B", 11)]
    assert [[(k, n) for k, _, n in x] for x in got[1:]] == [[("text", 300), ("text", 50)], [("table", 500), ("text", 10)], [("text", 10), ("text", 512), ("text", 188), ("text", 10)], [("code", 6)], [], []]


@pytest.mark.parametrize("seed", range(2))
def test_long_paragraphs_end_where_the_topic_changes(spark, seed):
    """Chunks of random bodies against a plain fold; the pieces of a paragraph are the paragraph to the character."""
    r = np.random.default_rng(seed)
    sentence = lambda: "".join(r.choice(list("退货商品 \u3000abc"), int(r.integers(1, 120)))) + r.choice(["。", "！ ", "\n", "?  "])
    paragraph = lambda n: "".join(sentence() for _ in range(n)).strip() or "x"
    bodies = ["\n\n".join([paragraph(30), "## H", paragraph(2), "| a | b |", paragraph(1), paragraph(25), "退" * 1100, "a b。 " + "货" * 600, paragraph(3)]) for _ in range(4)]
    angle = lambda i: float((i * 37) % 11)
    vec = lambda said: said.withColumn("vec", F.array(F.cos((F.col("pos") * 37 % 11).cast("double")), F.sin((F.col("pos") * 37 % 11).cast("double"))))
    far = lambda i: round(1 - (np.cos(angle(i)) * np.cos(angle(i + 1)) + np.sin(angle(i)) * np.sin(angle(i + 1))), 9)
    for body, rows in zip(bodies, chunk_rows(spark, bodies, vec)):
        want = list(plain_chunks(body, far, chunking.TERMINATORS))
        assert [(x.section_path, x.kind, x.body) for x in rows] == [(" > ".join(p), k, t) for p, k, t in want]
        whole = "".join(x.body for x in rows)
        for _, text in chunking.sections(body):
            for kind, block in chunking.blocks(text):
                assert kind != "text" or chunking.count_tokens(block) <= 512 or block in whole


@pytest.mark.parametrize("seed", range(3))
def test_semantic_chunks_match_a_plain_fold(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(p, i, int(r.integers(1, 60)), [float(x) for x in r.normal(size=3)]) for p, n in enumerate((1, 2, 30, 45)) for i in range(n)]
    got = {(x.paragraph, x.pos): x.chunk for x in semantic_chunks(spark.createDataFrame(rows, "paragraph int, pos int, n_tokens int, vec array<double>"), 100, 160).collect()}
    want = {}
    for p in range(4):
        own = [x for x in rows if x[0] == p]
        far = [round(1 - float(np.dot(a[3], b[3])), 9) for a, b in zip(own, own[1:])]
        line = sorted(far)[min(int(len(far) * 0.85), len(far) - 1)] if len(own) >= 3 else float("inf")
        chunk = size = 0
        for i, x in enumerate(own):
            if i and (size + x[2] > 160 or (far[i - 1] >= line and size >= 50)):
                chunk, size = chunk + 1, 0
            size += x[2]
            want[p, x[1]] = chunk
    assert got == want


def test_nearest_rank_is_by_index(spark):
    r = np.random.default_rng(1)
    rows = [("a", float(x)) for x in r.normal(size=501)] + [("b", 2.0)] * 4 + [("c", None), (None, 1.0)]
    got = {x.k: (x.p50, x.p99) for x in nearest_rank(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p99": 0.99}).collect()}
    a = sorted(x for k, x in rows if k == "a")
    assert got == {"a": (a[250], a[495]), "b": (2.0, 2.0)}


def test_masking_replaces_whole_values(spark):
    cases = {"x 11010519491231002X y": "x <id-card> y", "no 110105194913310021": "no <bank-card>", "call 13812345678!": "call <phone>!", "to a.b+c@d-e.org.": "to <email>"}
    got = spark.createDataFrame(list(cases.items()), "t string, want string").select(X.mask(F.col("t")), "want").collect()
    assert all(r[0].rstrip(".") == r[1].rstrip(".") for r in got)

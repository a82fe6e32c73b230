"""The pipeline's stages, each held against a plain version of it on what the stage before kept."""

from __future__ import annotations

import hashlib
import struct
from collections import Counter

import corpus_pipeline
import pytest
from tests.llm.test_operators import DOCS, ODD, brute_components, brute_fingerprint, brute_targets, words
from tokenizers import Tokenizer

from evistra.llm import bpe, pii, quality_classifier

NAMES = ["quality_classifier", "simhash_near_dedup", "pii", "mixing", "bpe"]


@pytest.fixture(scope="module")
def kept(spark, sf):
    """The documents, and what each stage made of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name)
        out[name] = docs
    out["bpe"] = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    return out


def test_stages_keep_the_documents_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert all(kept[n].columns == kept["documents"].columns for n in NAMES[:-1])


def test_rejected_documents_go(spark, sf, kept):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    accepted = {r.doc_id for r in quality_classifier.classifier_report(kept["documents"], labels).filter("accepted").collect()}
    got = [r.doc_id for r in kept["quality_classifier"].collect()]
    assert 0 < len(got) < kept["documents"].count() and len(got) == len(set(got)) and set(got) == accepted
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(good & accepted) >= 0.97 * len(good & {r.doc_id for r in kept["documents"].collect()})


def test_one_of_each_group_stays(kept):
    docs = sorted((r.doc_id, r.text) for r in kept["quality_classifier"].collect())
    comp = brute_components([brute_fingerprint(t) for _, t in docs])
    assert sorted(r.doc_id for r in kept["simhash_near_dedup"].collect()) == [docs[c][0] for i, c in enumerate(comp) if c == i]


def test_personal_data_is_replaced(kept):
    before = {r.doc_id: r.text for r in kept["simhash_near_dedup"].collect()}
    model = pii.trained()
    after = {r.doc_id: (r.text, r.n_chars) for r in kept["pii"].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        want, last = "", 0
        for a, b, kind in pii.find_spans(text, model)[1]:
            if a >= last:
                want += text[last:a] + f"<{kind}>"
            last = max(last, b)
        want += text[last:]
        assert after[i] == (want, len(want)) and not pii.base_spans(want)


def test_the_mix_meets_its_targets(kept):
    docs = {r.doc_id: r for r in kept["pii"].collect()}
    sizes, took, times = Counter(), Counter(), Counter()
    for r in docs.values():
        sizes[r.source] += len(words(r.text))
    for r in kept["mixing"].collect():
        full, part = words(docs[r.doc_id].text), words(r.text)
        assert r.source == docs[r.doc_id].source and part == full[: len(part)] and part
        took[r.source] += len(part)
        times[r.doc_id] += 1
    want = brute_targets(sizes)
    assert all(abs(took[s] - want[s]) <= 1 for s in sizes) and max(times.values()) <= 3


def test_tokens_are_the_tokenizers(kept):
    plain = Tokenizer.from_file(bpe.default_path())
    plain.no_truncation()
    plain.no_padding()
    want = Counter()
    for r in kept["mixing"].collect():
        ids = plain.encode(r.text, add_special_tokens=False).ids
        decoded = plain.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept["bpe"].collect()) == want


def test_run_gives_the_stages_rows(spark, sf, kept):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, kept["bpe"].collect()))


@pytest.mark.parametrize("name", NAMES)
def test_stages_on_odd_rows_and_empty_tables(spark, sf, name):
    """Nulls, repeats and clashing columns; nothing at all; null texts only."""
    odd, stage = spark.createDataFrame(ODD, DOCS), dict(corpus_pipeline.STAGES)[name]
    nulls = spark.createDataFrame([(i, None, None, None, None, None, None, None) for i in (1, 1, 2, None)], DOCS)
    got, none, bare = stage(spark, odd, sf), stage(spark, odd.limit(0), sf).collect(), stage(spark, nulls, sf).collect()
    assert none == [] and (name == "bpe" or got.columns == odd.columns)
    rows = Counter(r.doc_id for r in got.collect())
    if name in ("pii", "bpe"):
        assert rows == Counter(x[0] for x in ODD) and len(bare) == 4
    elif name == "simhash_near_dedup":
        assert rows == Counter([1, 4, 5, None, 6, 7]) and sorted(r.doc_id or 0 for r in bare) == [0, 1]
    elif name == "mixing":
        assert 1 not in rows and 2 not in rows and bare == []  # texts without words are not taken

"""Spelling variants, token counts and periodic runs against plain brute-force versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evistra.llm import periodic_runs, queries, spelling_variants, token_counts
from tests.llm.test_operators import DOCS, ODD

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# spelling variants


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(counts):
    """Near words through what is left after deleting one code point, told apart by comparing them."""
    stubs = defaultdict(set)
    for w in counts:
        stubs[w].add(w)
        for i in range(len(w)):
            stubs[w[:i] + w[i + 1 :]].add(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    links = defaultdict(set)
    for group in stubs.values():
        for a in group:
            links[a] |= {b for b in group if a != b and near(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n, len(links[w]), form[w], form[w] and counts[form[w]], root(w)) for w, n in counts.items())


def variant_rows(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


def test_spelling_variants(spark, sf, rows):
    want = brute_variants(brute_words(rows))
    assert any(w[3] for w in want)
    assert variant_rows(queries.op11_spelling_variants(spark, sf)) == want


def test_spelling_variants_of_a_chain_and_ties(spark):
    counts = {"abcdefgh": 100_000, "abcdefgx": 9_000, "abcdefyx": 800, "abcdezyx": 70, "abcdezy": 7, "bcdefgh": 3, "aaaaaaaa": 5, "aaaaaaa": 50, "aaaaaab": 50, "aaaaaaac": 4}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = variant_rows(spelling_variants.variants(words))
    assert got == brute_variants(counts)
    assert dict((r[0], r[5]) for r in got)["abcdezy"] == "abcdefgh"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=7, max_size=9), min_size=2, max_size=40))
def test_near_words_share_a_key(words):
    grams = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    rank = {g: i for i, g in enumerate(sorted(grams, key=lambda g: (grams[g], g)))}
    keys = {w: tuple(map(set, spelling_variants.keys_of(w, rank))) for w in words}
    for a in words:
        for b in words:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                assert keys[a][0] & keys[b][0]
            if len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b))):
                assert keys[a][0] & keys[b][1]


def test_spelling_variants_odd_rows(spark, odd, empty):
    want = brute_variants(brute_words([(r[0], r[1]) for r in ODD]))
    assert variant_rows(spelling_variants.variants_report(odd)) == want
    assert spelling_variants.variants_report(empty).count() == 0
    docs = [(1, "Straßen " * 3 + "STRAßEN stra×en÷s STRASSEN"), (2, "x" * 300_000 + " " + "x" * 300_000), (None, "Ÿnothing " * 5)]
    got = variant_rows(spelling_variants.variants_report(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute_variants(brute_words(docs))


# token counts


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(token_counts.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def check_counts(df, docs, plain):
    want = sorted((str(d), len((t or "").encode()), n := len(plain.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in docs)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect()) == want


def test_token_counts(spark, sf, rows, plain, odd, empty):
    check_counts(queries.op12_token_counts(spark, sf), rows, plain)
    check_counts(token_counts.counts_report(odd), [(r[0], r[1]) for r in ODD], plain)
    assert token_counts.counts_report(empty).count() == 0


def test_token_counts_without_a_table_and_with_small_caches(spark, sf, rows, plain, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 50)
    monkeypatch.setattr(token_counts, "FAN_IN", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    assert len(token_counts.frequent_pretokens(docs, token_counts.default_pattern(), 100)) == 100
    empty = token_counts.Counts(token_counts.default_path(), token_counts.default_pattern(), token_counts.LengthTable({}))
    for _, text in rows[:40]:
        assert empty.of_document(text) == len(plain.encode(text, add_special_tokens=False).ids)


PARTS = ["a", "B", "é", "'s", "'", " ", " ", "\n", "\t", "1", "²", "!", "<|", "endoftext", "|>", "<|endoftext|>", "中", "ʰ", "\x1c", "\x85", "\0", "́", "😀", "ſ", " ", "​"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_token_counts_of_any_white_space_and_special_strings(text):
    path = token_counts.default_path()
    counts = token_counts.Counts(path, token_counts.default_pattern(), token_counts.length_table([" a", "  ", "\n"], path))
    assert counts.of_document(text) == len(token_counts.tokenizer(path).encode(text, add_special_tokens=False).ids)


def test_length_table_answers_for_its_keys_only():
    keys = {f"k{i}".encode(): i for i in range(5000)}
    table = token_counts.LengthTable(keys).views()
    assert all(table.get(k) == n for k, n in keys.items())
    assert not any(table.get(f"k{i}".encode()) is not None for i in range(5000, 9000))


# periodic runs


def brute_planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_runs(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda t: (t[0], t[2]))


def brute_report(doc_id, text):
    words = brute_planted(re.findall("[^\x20\x09-\x0d]+", text or ""), doc_id)
    runs = brute_runs(words)
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    best = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def run_rows(df):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_periodic_runs(spark, sf, rows):
    want = sorted((brute_report(*r) for r in rows), key=str)
    assert any(w[1] for w in want)
    assert run_rows(queries.op13_periodic_runs(spark, sf)) == want


def test_periodic_runs_of_long_texts_by_ranges_of_lags(spark, sf, rows, monkeypatch):
    """All texts of over 64 bytes as ranges of few lags, some rows twice."""
    monkeypatch.setattr(periodic_runs, "RANGE_WORK", 3000)
    monkeypatch.setattr(periodic_runs, "RANGE_WORDS", 1)
    docs = [*rows, *rows[:20], *((None, r[1]) for r in rows[:20])]
    got = periodic_runs.runs_report(spark.createDataFrame(docs, "doc_id long, text string"), long_bytes=64)
    assert run_rows(got) == sorted((brute_report(*r) for r in docs), key=str)


def test_periodic_runs_of_random_words():
    pick = random.Random(7)
    for _ in range(60):
        lists = [[pick.choice([b"a", b"b", b"c"][: pick.randint(1, 3)]) for _ in range(pick.randint(0, 70))] for _ in range(15)]
        assert periodic_runs.scan_together(lists) == [brute_runs(x) for x in lists]


def test_periodic_runs_odd_rows(odd, empty):
    got = run_rows(periodic_runs.runs_report(odd))
    assert got == sorted((brute_report(r[0], r[1]) for r in ODD), key=str)
    assert periodic_runs.runs_report(empty).count() == 0


@pytest.mark.parametrize("report", [spelling_variants.variants_report, token_counts.counts_report, periodic_runs.runs_report])
def test_null_texts_only_and_a_very_long_text(spark, report):
    assert report(spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")).count() in (0, 2)
    long = " ".join(f"wordword{i % 977}" for i in range(60_000))
    got = report(spark.createDataFrame([(1, long)], "doc_id long, text string")).collect()
    assert got and ("n_runs" not in got[0] or (got[0]["n_runs"], got[0]["period"]) == (1, 977))

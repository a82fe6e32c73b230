"""Span trees against walks from parent to parent, and covered time against single seconds."""

from __future__ import annotations

import random

import pytest

from evistra.operators import spans as S


@pytest.mark.parametrize("seed", range(2))
def test_roots_and_depths(spark, seed):
    """Random trees, a chain of seventy, a span whose parent is missing, and a ring, which has no root."""
    pick = random.Random(seed)
    parent = {i: (pick.randrange(i) if i % 9 else None) for i in range(1, 60)} | {i: i - 1 if i > 100 else None for i in range(100, 170)} | {200: 999, 300: 301, 301: 302, 302: 300, 303: 300, 0: None}
    rows = spark.createDataFrame([(k, p) for k, p in parent.items()], "span_id long, parent_id long")

    def walk(i):
        depth = 0
        while parent[i] in parent:
            i, depth = parent[i], depth + 1
            if depth > len(parent):
                return None, None
        return i, depth

    got = {r.span_id: (r.root_id, r.depth) for r in S.with_roots(rows).collect()}
    assert got == {i: walk(i) for i in parent} and got[169] == (100, 69) and got[303] == (None, None) and got[200] == (200, 0)


def test_no_spans(spark):
    assert S.with_roots(spark.createDataFrame([], "span_id long, parent_id long")).count() == 0


def test_overlaps_count_once(spark):
    pick = random.Random(3)
    rows = [(k, a := pick.randrange(200), a + pick.randrange(30)) for k in range(8) for _ in range(k + 1)] + [(9, 5, 5), (9, 0, 10), (9, 10, 12), (9, 20, 21)]
    got = {r.k: r.seconds for r in S.covered(spark.createDataFrame(rows, "k int, started long, ended long"), ["k"]).collect()}
    assert got == {k: len({s for q, a, b in rows if q == k for s in range(a, b)}) for k in {r[0] for r in rows}}


def test_larger_samples_hold_smaller_ones(spark):
    rows = spark.range(3000)
    got = [(r.a, r.b) for r in rows.select(S.chosen(rows.id, 20).alias("a"), S.chosen(rows.id, 10).alias("b")).collect()]
    assert all(a for a, b in got if b) and 480 < sum(a for a, _ in got) < 720 and 220 < sum(b for _, b in got) < 380

"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints are made per document, collapsed to distinct values, and compared inside groups that agree on
enough bit segments: with m segments, two fingerprints at most DISTANCE bits apart agree on at least
m - DISTANCE of them, so each such choice of segments is one set of groups and no link is lost. m follows from the
number of distinct fingerprints, which keeps groups small at any size. Inside a group the fingerprints are sorted
by Gray rank; each index node keeps the bits all its members share (mask and pattern), and pairs of nodes whose
shared bits already differ in more than DISTANCE places are dropped with everything below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import batches_of, block_pairs, components, groups, join_hot, materialize, merge_labels, slices, text_column

DISTANCE = 4
SHINGLE = 4
#: Children of an index node, rows of a group that one task holds, node pairs looked at in one step.
FANOUT, GROUP_ROWS, STEP = 8, 4096, 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = len(words)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    starts, ends = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 1 << 15):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)])], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of all documents; fp holds the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(x) for x in batches_of(b.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def near_pairs(fps: np.ndarray, other: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most `distance` bits apart, of fps with itself or with other, in bounded pieces."""

    def index(x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        order = np.argsort(gray_rank(x), kind="stable")
        every, some = [x[order]], [x[order]]
        while len(every[-1]) > FANOUT:
            cuts = np.arange(0, len(every[-1]), FANOUT)
            every.append(np.bitwise_and.reduceat(every[-1], cuts))
            some.append(np.bitwise_or.reduceat(some[-1], cuts))
        return order, [(a, ~(a ^ o)) for a, o in zip(every, some)]  # pattern, mask of shared bits

    order, levels = index(fps)
    order2, levels2 = (order, levels) if other is None else index(other)
    while len(levels) < len(levels2):
        levels.append(levels[-1])
    while len(levels2) < len(levels):
        levels2.append(levels2[-1])
    top = len(levels) - 1
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(levels[top][0])), np.arange(len(levels2[top][0])), indexing="ij"))
    todo = [(top, a, b)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > STEP:
            todo += [(level, a[i : i + STEP], b[i : i + STEP]) for i in range(0, len(a), STEP)]
            continue
        if other is None:
            keep = a <= b
            a, b = a[keep], b[keep]
        (pa_, ma), (pb, mb) = levels[level], levels2[level]
        near = np.bitwise_count((pa_[a] ^ pb[b]) & ma[a] & mb[b]) <= distance
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level == 0:
            if other is None:
                keep = a < b
                a, b = a[keep], b[keep]
            yield order[a], order2[b]
            continue
        na, nb = len(levels[level - 1][0]), len(levels2[level - 1][0])
        down_a = FANOUT if na > len(levels[level][0]) else 1
        down_b = FANOUT if nb > len(levels2[level][0]) else 1
        a = (a[:, None, None] * down_a + np.arange(down_a)[None, :, None] + np.zeros((1, 1, down_b), dtype=np.int64)).ravel()
        b = (b[:, None, None] * down_b + np.arange(down_b)[None, None, :] + np.zeros((1, down_a, 1), dtype=np.int64)).ravel()
        inside = (a < na) & (b < nb)
        todo.append((level - 1, a[inside], b[inside]))


def segments(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks to group by, for n distinct fingerprints: the fewest segments that leave small groups."""
    for m in range(distance + 1, 2 * distance + 1):
        edges = [64 * i // m for i in range(m + 1)]
        if m == 2 * distance or n >> (min(edges[i + 1] - edges[i] for i in range(m)) * (m - distance)) <= 2048:
            one = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(m)]
            return [sum(c) for c in combinations(one, m - distance)]
    raise AssertionError


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect all that are linked: a spanning forest per group."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = segments(nodes.count(), distance)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("part", "key"))
    spread = block_pairs(keyed, ["part", "key"], F.col("fp"), GROUP_ROWS)
    where = ["part", "key", "pair_a", "pair_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        size = 0
        for (_, _, i, j), g in groups(batches, where):
            if g.num_rows < 2:
                continue
            fp = g.column("fp").to_numpy().view(np.uint64)
            first = g.column("block").to_numpy() == i
            fp = np.concatenate((fp[first], fp[~first]))
            cut = int(first.sum())
            labels = np.arange(len(fp))
            if i == j:
                for a, b in near_pairs(fp, None, distance):
                    merge_labels(labels, a, b)
            elif 0 < cut < len(fp):
                for a, b in near_pairs(fp[:cut], fp[cut:], distance):
                    merge_labels(labels, a, b + cut)
            moved = np.flatnonzero(labels != np.arange(len(fp)))
            if len(moved):
                out.append(np.stack((fp[moved], fp[labels[moved]])).view(np.int64))
                size += len(moved)
            if size > 1 << 16:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(out, axis=1))), names=["a", "b"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(out, axis=1))), names=["a", "b"])

    return spread.repartition(*where).sortWithinPartitions(*where).mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Null texts count as empty; texts without words have fingerprint zero and link like any other. Rows with a null
    doc_id take part but never name a component (a component of only such rows gets null); repeated rows stay.
    """
    fps = materialize(fingerprints(docs), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).checkpoint()
    comp = components(links(nodes.select("fp"), distance))
    linked = nodes.join(comp.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    of_linked = join_hot(linked.select("fp", "component"), lowest, "component", nodes.count(), F.col("fp")).select("fp", "component_id")
    by_fp = nodes.join(of_linked.withColumn("there", F.lit(True)), "fp", "left").select("fp", "_n", F.when(F.col("there"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    named = join_hot(fps, by_fp, "fp", fps.count(), F.col("doc_id"))
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents' columns for one document of each component, its smallest doc_id.

    Where that doc_id itself repeats, one of its rows stays. Rows with a null doc_id can't be named and all stay.
    """
    found = materialize(simhash_components(docs, distance), "kept")
    losers = found.filter("doc_id <> component_id").select("doc_id").distinct()
    out = docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    once = out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return out.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)

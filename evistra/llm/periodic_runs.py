"""Periodic runs of words by an all-lag scan.

A text's words become numbers, and the array of numbers is compared with itself shifted by every lag up to n / MIN_EXP.
Where it equals its shift for long enough, the stretch of equal places is a run with that lag as a period. Short texts
are scanned where they are read, many of them in one array. A long text goes out as ranges of lags of about equal
work, so that its n * n comparisons are shared by many tasks, and its runs are put together again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import packed, slices, text_column, unpacked

#: A run holds its period at least MIN_EXP times and MIN_LENGTH words.
MIN_EXP, MIN_LENGTH = 4, 6
#: Bytes beyond which a text's lags are dealt among tasks; comparisons of a range of lags, for each word of the text at least.
LONG_BYTES, RANGE_WORK, RANGE_WORDS = 32_768, 1 << 25, 2048

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, those from word a on replaced by repeats of the p words there where crc32 of doc_id ends in 0."""
    if doc_id is None or not words:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def least_equal(p: int) -> int:
    """Places that have to equal their shift by p in a run of period p."""
    return max(MIN_LENGTH - p, (MIN_EXP - 1) * p)


def scan(x: np.ndarray, low: int, high: int, reach: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, end, period) of the maximal stretches of x with a period from low to high, of each stretch its smallest.

    With reach, lag p looks at the first reach[p] places only. A stretch of at least `step` equal places covers one of
    every `step` places, so lags without an equal one among those have no run and are not run-length coded.
    """
    found: dict[tuple[int, int], int] = {}
    for p in range(low, high + 1):
        size = len(x) if reach is None else int(reach[p])
        equal, step = x[p:size] == x[: max(size - p, 0)], least_equal(p)
        if not equal[step - 1 :: step].any():
            continue
        edges = np.flatnonzero(equal[1:] != equal[:-1]) + 1
        starts = np.concatenate(([0], edges))
        lengths = np.diff(np.concatenate((starts, [len(equal)])))
        for i in np.flatnonzero(equal[starts] & (lengths >= step)).tolist():
            found.setdefault((int(starts[i]), int(starts[i] + lengths[i] + p)), p)
    return [(a, b, p) for (a, b), p in found.items()]


def scan_together(lists: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period.

    The lists lie in one array, the longest first, so that a lag looks at a prefix of it. A mark of its own ends each
    list; between two marks fewer than p places can equal their shift by p across one, too few for a run.
    """
    order = sorted(range(len(lists)), key=lambda i: -len(lists[i]))
    order = [i for i in order if len(lists[i]) >= MIN_LENGTH]
    numbers, runs = _Numbers(), [[] for _ in lists]
    if not order:
        return runs
    lengths = np.array([len(lists[i]) for i in order], dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    x = np.empty(int(ends[-1]), dtype=np.uint32)
    for k, i in enumerate(order):
        at = int(ends[k] - lengths[k] - 1)
        x[at : ends[k] - 1] = np.fromiter(map(numbers.__getitem__, lists[i]), dtype=np.uint32, count=len(lists[i]))
    x[ends - 1] = np.arange(len(numbers), len(numbers) + len(order), dtype=np.uint32)
    if len(numbers) + len(order) <= 1 << 16:
        x = x.astype(np.uint16)
    high = int(lengths[0]) // MIN_EXP
    # how many lists are long enough for lag p, and where they end
    many = np.searchsorted(-lengths, -np.maximum(MIN_EXP * np.arange(high + 1), MIN_LENGTH), side="right")
    got = scan(x, 1, high, np.concatenate(([0], ends))[many])
    for start, end, p in got:
        k = int(np.searchsorted(ends, start, side="right"))
        runs[order[k]].append((start - int(ends[k] - lengths[k] - 1), end - start, p))
    for r in runs:
        r.sort(key=lambda t: (t[0], t[2]))
    return runs


def digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The columns of RESULT from a text's words and all its runs (start, length, period) in order."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int32)
        for start, length, p in runs:
            change[start + p] += 1
            change[start + length] -= 1
        dropped = np.cumsum(change[:-1]) > 0
        words = [w for w, d in zip(words, dropped.tolist()) if not d]
    start, length, p = min(runs, key=lambda t: (-t[1], t[0], t[2])) if runs else (None, None, None)
    return (
        len(runs), start, length, p, 1000 * length // p if runs else None,
        hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(words)).hexdigest(),
    )


_ARROW = [pa.int64()] * 5 + [pa.string()] * 2
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _rows(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    cols = zip(*found) if found else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, _ARROW))], names=["doc_id", *_NAMES])


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [planted(t.split(), d) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 256):
        lists = _words(b)
        yield _rows(b.column("doc_id"), list(map(digest, lists, scan_together(lists))))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's numbers once for each range of its lags; ranges take about equal numbers of comparisons."""
    names = ["id0", "mark", "low", "high", "numbers"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    for b in slices(batches, 1):
        words, numbers = _words(b)[0], _Numbers()
        n, high = len(words), len(words) // MIN_EXP
        if n < MIN_LENGTH:
            continue
        row = packed(np.fromiter(map(numbers.__getitem__, words), dtype="<u4", count=n))
        done = np.cumsum(n - np.arange(1, high + 1, dtype=np.int64))
        parts = -(-int(done[-1]) // max(RANGE_WORK, RANGE_WORDS * n))
        cuts = [0, *(np.searchsorted(done, done[-1] * np.arange(1, parts) // parts) + 1).tolist(), high]
        for low, to in zip(cuts, cuts[1:]):
            if low < to:
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((b.column("id0")[0].as_py(), b.column("mark")[0].as_py(), low + 1, to, row), kinds)], names=names)


def _scan_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        for id0, mark, low, high, numbers in zip(*(c.to_pylist() for c in b.columns)):
            got = scan(unpacked(numbers), low, high)
            cols = [[id0] * len(got), [mark] * len(got), [a for a, _, _ in got], [e - a for a, e, _ in got], [p for _, _, p in got]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id0", "mark", "start", "length", "period"])


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 16):
        runs = [sorted(((r["start"], r["length"], r["period"]) for r in x or ()), key=lambda t: (t[0], t[2])) for x in b.column("runs").to_pylist()]
        yield _rows(b.column("doc_id"), list(map(digest, _words(b), runs)))


def runs_report(docs: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id and the runs of each whole text: how many, the longest, digests of all and of the text without repeats.

    A null or empty text, and one of fewer than MIN_LENGTH words, has no runs: n_runs is 0, the longest run's columns
    are null, and the digests are those of no runs and of the words as they are. Repeated rows give a row each. A text
    without a doc_id is scanned as it is, without planted repeats. Other columns are not looked at.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).cast("binary").alias("text"))
    short = rows.filter(F.octet_length("text") <= long_bytes).mapInArrow(_whole, "doc_id long, " + RESULT)
    long = rows.filter(F.octet_length("text") > long_bytes).select("*", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.xxhash64("doc_id", "text").alias("mark"))
    # equal rows have equal runs: they are scanned once, and every row gets the runs by the join
    ranges = long.dropDuplicates(["id0", "mark"]).mapInArrow(_ranges, "id0 long, mark long, low int, high int, numbers binary")
    found = ranges.repartition(parts, "id0", "mark", "low").mapInArrow(_scan_range, "id0 long, mark long, start long, length long, period long")
    found = found.groupBy("id0", "mark", "start", "length").agg(F.min("period").alias("period"))
    found = found.groupBy("id0", "mark").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    whole = long.join(found, ["id0", "mark"], "left").mapInArrow(_with_runs, "doc_id long, " + RESULT)
    return short.unionByName(whole)

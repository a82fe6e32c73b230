"""Spelling variants by a rare-first q-gram prefix filter.

One edit changes at most Q of a word's bigrams, so of the PREFIX = Q + 1 bigrams that are rarest overall at least one
of one of two near words is in the other as well, at a position that the edit can't have moved by more than one. All
bigrams are ordered by their number in the different words; each word is looked up by its three rarest only.

A shared bigram splits the edit's place in two: it lies before the bigram or after it, and the other side is the same
in both words. The side with the edit is halved once more, and one half has to be the same too. The join's key holds
the bigram, its position, how long the edited side is and both equal parts, so that candidates share more than half
of their characters at the same places; levenshtein() then tells the near words among them.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import materialize, slices, text_column

#: Bigrams; one edit can change two of them, so three are looked up.
Q, PREFIX = 2, 3
#: Code points of a word and its occurrences at least; how many times as frequent a form is; deletions are one in SPOILT.
MIN_LENGTH, MIN_COUNT, TIMES, SPOILT = 7, 2, 10, 31
#: Different words a task counts before it passes them on; words whose keys one task makes.
MEMO_WORDS, KEYED_WORDS = 150_000, 20_000

#: Latin-1 characters by code: letters of the runs as they are, all others as spaces.
_LETTERS = bytes(c if chr(c).isascii() and chr(c).isalpha() or c >= 0xC0 else 0x20 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of [A-Za-z] and U+00C0 to U+00FF as Latin-1, a byte a code point, A-Z in lower case."""
    return text.encode("latin-1", "replace").lower().translate(_LETTERS).split()


def spoilt(run: bytes, seed: int) -> bytes:
    """The run, a code point deleted where SPOILT divides the crc32 of `<doc_id>:<run>`; seed is that of `<doc_id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % SPOILT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all whole texts, summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        total: Counter = Counter()
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = Counter(w for w in runs_of(text) if len(w) >= MIN_LENGTH)
                seed = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for word, n in found.items():
                    if seed is not None:
                        word = spoilt(word, seed)
                    total[word] += n
                if len(total) > MEMO_WORDS:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    parts = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")).mapInArrow(run, "word string, n long")
    return parts.filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigram -> its place among all by the number of occurrences in the different words, rarest first.

    The alphabet bounds their number: 90 letters make 8100 bigrams, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                found.update(map("".join, zip(w, w[1:])))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"])))}


def rarest(word: str, rank: dict[str, int]) -> list[int]:
    """Positions of the word's PREFIX rarest bigrams, and of the first PREFIX occurrences of each of those.

    An edit takes at most Q occurrences of a bigram away and adds at most Q, so the first occurrence that is in both
    words is among the first PREFIX of each.
    """
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    first = {grams[i] for i in heapq.nsmallest(PREFIX, range(len(grams)), key=lambda i: (rank[grams[i]], i))}
    at: dict[str, list[int]] = {g: [] for g in first}
    for i, g in enumerate(grams):
        if g in first and len(at[g]) < PREFIX:
            at[g].append(i)
    return [i for found in at.values() for i in found]


def keys_of(word: str, rank: dict[str, int]) -> tuple[list[str], list[str]]:
    """Keys of a word as the shorter or equally long of two near words, and as the longer one by a code point.

    A key names the bigram's position from the unedited end, the length of the edited side in the shorter word, which
    half of that side is the same, and the equal parts: `side` is the edited one, "<" before the bigram, ">" after it.
    """
    same, longer = [], []
    for p in rarest(word, rank):
        for side, fixed, edited in ((">", word[: p + 2], word[p + 2 :]), ("<", word[p:], word[:p])):
            place, m = len(fixed), len(edited)
            h = m // 2
            same.append(f"{side}{place}.{m}a{fixed} {edited[:h]}")
            if h:
                same.append(f"{side}{place}.{m}b{fixed} {edited[h:]}")
            if m:  # without one of its code points the edited side is m - 1 long
                h = (m - 1) // 2
                longer.append(f"{side}{place}.{m - 1}a{fixed} {edited[:h]}")
                if h:
                    longer.append(f"{side}{place}.{m - 1}b{fixed} {edited[h + 1 :]}")
    return same, longer


def keyed(words: DataFrame, rank: dict[str, int]) -> DataFrame:
    """(key, longer, word, n): a row for each key of each word, longer where it is the longer one's."""
    ranks = words.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ranks.value
        for b in slices(batches, 1024):
            keys, longer, at = [], [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                for kind, found in enumerate(keys_of(w, of)):
                    found = {xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in found}
                    keys += found
                    longer += [bool(kind)] * len(found)
                    at += [i] * len(found)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(longer, pa.bool_()), b.column(0).take(rows), b.column(1).take(rows)], names=["key", "longer", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, longer boolean, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): every two words that one edit apart, once, from (word, n) with different words."""
    parts = max(1, -(-words.count() // KEYED_WORDS))
    rows = keyed(words.select("word", "n").repartition(parts), bigram_ranks(words))
    left = rows.filter(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    right = rows.select("key", F.col("longer"), F.col("word").alias("b"), F.col("n").alias("nb"))
    near = (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    return left.join(right, "key").filter(near).select("a", "na", "b", "nb").distinct()


def _better(n: Column, word: Column) -> Column:
    """Sorts the more frequent first, then by code points."""
    return F.struct((-n).alias("m"), word.alias("w"))


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n), a row a word.

    A form is a word's most frequent near word, the first by code points among equals, if at least TIMES as frequent;
    the root is the last word that forms lead to. Each form is TIMES as frequent as what it is the form of, so a chain
    is no longer than the digits of the largest count: it is followed by doubling, over the few words that have a form.
    """
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")),
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(_better(F.col("near_n"), F.col("near"))).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.w").alias("near"), (-F.col("best.m")).alias("near_n"))
    is_form = F.col("near_n") >= TIMES * F.col("n")
    known = known.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    known = materialize(known, "variants")
    step = known.filter("form is not null").select("word", F.col("form").alias("root"))
    top = known.agg(F.max("n")).first()[0] or 0
    longest = int(math.log(max(top, 1), TIMES)) + 1
    for _ in range(math.ceil(math.log2(longest + 1))):
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return known.join(step, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants_report(docs: DataFrame) -> DataFrame:
    """variants of the words of all whole texts, each counted over all documents.

    A null or empty text has no words; repeated rows count again; in a text without a doc_id no letter is deleted.
    Other columns are not looked at. Without words of MIN_LENGTH code points there are no rows.
    """
    return variants(materialize(word_counts(docs), "words"))

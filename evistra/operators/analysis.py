"""Terms of texts that put no spaces between words: the best path through the lattice of a lexicon's words.

Every word of the lexicon that a run of ideographs holds is an edge from its first to behind its last character, and
every character by itself is one, too. An edge weighs the logarithm of its word's share of all words; the path of the
greatest sum cuts the run into words. Weights are whole thousandths, so paths are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a lexicon at most, the most frequent, and characters of a word: what is broadcast stays under some 10 MB.
LEXICON_WORDS, LONGEST = 200_000, 8
#: Runs whose cut a worker remembers, and texts whose terms it holds at a time.
MEMO_RUNS, SLICE = 5_000, 256
IDEOGRAPHS = r"[\x{4e00}-\x{9fff}]"
#: A run of ideographs, or of other letters and digits.
TERM = IDEOGRAPHS + r"+|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+"

Analyzer = Callable[[Column], Column]


def lexicon(words: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """(word, weight) of the `most` most frequent words of (word, n), ties by the word; those over LONGEST are left out.

    A last row, without a word, has the weight of a character that is no word: that of one occurrence among all.
    """
    known = words.filter((F.length("word") <= LONGEST) & (F.length("word") > 0)).orderBy(F.desc("n"), "word").limit(most)
    weight = lambda n: F.round(1000 * F.log(n / F.col("total"))).cast("long").alias("weight")
    total = known.agg(F.sum("n").cast("double").alias("total"))
    rows = known.crossJoin(F.broadcast(total)).select("word", weight(F.col("n")))
    return rows.union(total.filter("total is not null").select(F.lit(None).cast("string"), weight(F.lit(1.0))))


def best_path(run: str, weights: dict[str, int], least: int) -> list[str]:
    """The run cut into words; of equal paths the one whose first words are longer."""
    n = len(run)
    best, length = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        best[i] = weights.get(run[i], least) + best[i + 1]
        for k in range(2, min(LONGEST, n - i) + 1):
            w = weights.get(run[i : i + k])
            if w is not None and w + best[i + k] >= best[i]:
                best[i], length[i] = w + best[i + k], k
    out, i = [], 0
    while i < n:
        out.append(run[i : i + length[i]])
        i += length[i]
    return out


def analyzer(words: DataFrame) -> Analyzer:
    """text -> its terms in order, by a lexicon (word, weight): ideographs in words, other runs whole in lower case.

    The lexicon, of at most LEXICON_WORDS, goes to every worker. A null text has no terms.
    """
    rows = {r["word"]: r["weight"] for r in words.limit(LEXICON_WORDS + 1).collect()}
    least = rows.pop(None, -1000)
    shared = words.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf("array<string>")
    def cut(runs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, memo = shared.value, {}

        def words_of(run: str) -> list[str]:
            if not "一" <= run[0] <= "鿿":
                return [run]
            found = memo.get(run)
            if found is None:
                if len(memo) >= MEMO_RUNS:
                    memo.clear()
                found = memo[run] = best_path(run, weights, least)
            return found

        for batch in runs:
            for at in range(0, len(batch), SLICE):
                yield pd.Series([None if row is None else [w for run in row for w in words_of(run)] for row in batch.iloc[at : at + SLICE]])

    return lambda text: F.coalesce(cut(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))), F.array().cast("array<string>"))


def word_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """(word, n) of the texts' words by a pattern, in lower case."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))

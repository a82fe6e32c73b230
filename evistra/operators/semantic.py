"""Splitting long paragraphs where their topic changes: distances of neighbouring sentences, a percentile, a fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BREAK_PERCENTILE, MIN_FILL, LEAST_SENTENCES = 85, 0.5, 3


def distances(sentences: DataFrame) -> DataFrame:
    """sentences (paragraph, pos, vec, ...) with `far`, 1 - the product of a sentence's vector with the one before (null for
    the first), and `threshold`, the paragraph's nearest-rank percentile of these by index."""
    order = Window.partitionBy("paragraph").orderBy("pos")
    dot = F.aggregate(F.zip_with("vec", "_before", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    s = sentences.withColumn("_before", F.lag("vec").over(order)).withColumn("far", F.round(1 - dot, 9)).drop("_before", "vec")
    n, rank = F.count("far").over(Window.partitionBy("paragraph")), F.row_number().over(Window.partitionBy("paragraph").orderBy(F.asc_nulls_last("far"), "pos")) - 1
    at = F.least(F.floor(n * BREAK_PERCENTILE / 100), n - 1)
    s = s.withColumn("_at", at).withColumn("_rank", rank)
    return s.withColumn("threshold", F.max(F.when(F.col("_rank") == F.col("_at"), F.col("far"))).over(Window.partitionBy("paragraph"))).drop("_at", "_rank")


def semantic_chunks(sentences: DataFrame, target: int, most: int) -> DataFrame:
    """(paragraph, pos, chunk): which chunk each sentence falls into.

    A chunk ends before a sentence that would take it over `most` tokens, or that is at least as far from the one before
    as the paragraph's threshold, once the chunk holds MIN_FILL of `target`. Paragraphs of fewer than LEAST_SENTENCES
    have no such breaks and are only cut at `most`. Rows are read in order; a task keeps a paragraph's running size.
    """
    d = distances(sentences).withColumn("sentences", F.count(F.lit(1)).over(Window.partitionBy("paragraph")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paragraph, chunk, size = None, 0, 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.paragraph != paragraph:
                    paragraph, chunk, size = r.paragraph, 0, 0
                shift = r.sentences >= LEAST_SENTENCES and r.far >= r.threshold and size >= target * MIN_FILL
                if size and (size + r.n_tokens > most or shift):
                    chunk, size = chunk + 1, 0
                size += r.n_tokens
                out.append(chunk)
            yield frame[["paragraph", "pos"]].assign(chunk=out)

    dealt = d.select("paragraph", "pos", "n_tokens", "far", "threshold", "sentences").repartition("paragraph").sortWithinPartitions("paragraph", "pos")
    return dealt.mapInPandas(run, f"paragraph {d.schema['paragraph'].dataType.simpleString()}, pos int, chunk int")

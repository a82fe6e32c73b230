"""Span trees: roots, depths, time with overlaps counted once, and samples drawn by whole trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistra.sources.shared import kept


def with_roots(spans: DataFrame) -> DataFrame:
    """spans (span_id, parent_id, ...) with root_id and depth, that of a root being 0.

    A span without a parent, or whose parent is none of the spans, is a root. Every round doubles the steps that each
    span has gone up, so a tree takes as many joins as its depth has binary digits, whatever its size; only spans that
    haven't arrived are joined again, and a span that is its own ancestor gets no root. span_ids differ.
    """
    up = spans.select(F.col("span_id").alias("_id"), F.col("parent_id").alias("_parent"))
    own = up.select(F.col("_id").alias("_known"))
    step = up.join(own, F.col("_parent") == F.col("_known"), "left").select("_id", F.coalesce("_known", "_id").alias("at"), F.col("_known").isNull().alias("done"), F.col("_known").isNotNull().cast("long").alias("steps"))
    step = kept(step, "steps")
    for _ in range(spans.count().bit_length()):
        arrived, left = step.filter("done"), step.filter("not done")
        if left.isEmpty():
            break
        ahead = step.select(F.col("_id").alias("at"), F.col("at").alias("next"), F.col("done").alias("_top"), F.col("steps").alias("_more"))
        moved = left.drop("done").join(ahead, "at").select("_id", F.col("next").alias("at"), F.col("_top").alias("done"), (F.col("steps") + F.col("_more")).alias("steps"))
        step = kept(arrived.unionByName(moved), "steps")
    arrived = step.filter("done")
    return spans.join(arrived.select(F.col("_id").alias("span_id"), F.col("at").alias("root_id"), F.col("steps").alias("depth")), "span_id", "left")


def covered(spans: DataFrame, keys: list[str], begin: str = "started", end: str = "ended") -> DataFrame:
    """(*keys, seconds): the time that a group's spans cover, where they overlap counted once.

    A span that begins after all before it have ended opens an island; an island lasts until the last end in it.
    """
    order = Window.partitionBy(*keys).orderBy(begin, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before.isNull() | (F.col(begin) > before), 1).otherwise(0))
    islands = marked.withColumn("_island", F.sum("_new").over(order)).groupBy(*keys, "_island").agg((F.max(end) - F.min(begin)).alias("_long"))
    return islands.groupBy(*keys).agg(F.sum("_long").alias("seconds"))


def chosen(root: Column, share: int) -> Column:
    """Whether a tree is in a sample of `share` in a hundred, by its root: larger shares hold the smaller ones."""
    return F.conv(F.substring(F.md5(root.cast("string")), 1, 6), 16, 10).cast("int") % 100 < share

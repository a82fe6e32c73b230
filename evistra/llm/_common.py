"""Shared helpers of the corpus operators: shared-folder tables, word splitting, components."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evistra.sources.shared import folder as shared_folder  # noqa: F401
from evistra.sources.shared import kept as materialize, shared_dir

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are gone: it does so once the driver has collected them.

    Python's side lets go in a thread of its own, hence the waits.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def text_column(docs: DataFrame) -> Column:
    """The text with null as the empty text."""
    return F.coalesce(docs["text"], F.lit(""))


def batches_of(col: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column without decoding them."""
    return col.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few texts, so that a worker holds little of what it makes of them at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def packed(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers for the shuffle and the disk: length, and their bytes by significance, compressed."""
    raw = x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(row: bytes, kind: str = "<u4") -> np.ndarray:
    size = int.from_bytes(row[:8], "little")
    if not size:
        return np.empty(0, dtype=kind)
    raw = np.frombuffer(pa.decompress(row[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of the batches in which keys don't change; consecutive pieces may have the same key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            yield tuple(c[a] for c in cols), batch.slice(a, b - a)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive groups of a stream that is clustered and sorted by keys; holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for key, part in runs(batches, keys):
        if last is not None and key != last:
            yield last, pa.Table.from_batches(held)
            held = []
        held.append(part)
        last = key
    if held:
        yield last, pa.Table.from_batches(held)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i] in place; labels[i] ends as the smallest index of i's class."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b = la[apart], lb[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def block_pairs(df: DataFrame, keys: list[str], spread: Column, limit: int) -> DataFrame:
    """Split each group of over `limit` rows into blocks and send every row to all pairs of blocks it belongs to.

    Adds block, pair_a <= pair_b. Groups within the limit get block 0 and the pair (0, 0). Two rows of a group
    meet in exactly one pair unless they share a block, where they meet in the pair (block, block) and must be
    compared only there. No task holds more than about two blocks, and none of a group's pairs is lost.
    """
    big = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_g"))
    )
    out = df.join(big, keys, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    out = out.withColumn("block", F.when(F.col("_g") == 1, 0).otherwise(F.pmod(F.xxhash64(spread, F.lit("block")), F.col("_g"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_other")
    return (
        out.select("*", other)
        .withColumn("pair_a", F.least("block", "_other"))
        .withColumn("pair_b", F.greatest("block", "_other"))
        .drop("_g", "_other")
    )


#: A key with more than this share of all rows is hot; there can't be more than 1 / HOT of them.
HOT = 1 / 2000


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int, spread: Column) -> DataFrame:
    """rows with the columns of their key's row in table (one row a key, with `_n`, the rows that have the key), if any.

    Hot keys' rows of the table, whose number HOT bounds, are broadcast; the rows that have them are dealt by `spread`.
    """
    cols = [c for c in table.columns if c not in (key, "_n")]
    hot = table.filter(F.col("_n") > int(total * HOT)).select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in cols))
    out = rows.join(F.broadcast(hot), key, "left").withColumn("_deal", F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(F.lit(0).cast("long")))
    zero = F.pmod(F.col("_n"), F.lit(1)).cast("long").alias("_deal")  # not a literal, which the planner would take out of the keys
    out = out.join(table.select(key, zero, *cols), [key, "_deal"], "left")
    return out.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in cols))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) per linked node, component its smallest node.

    Alternating large-star and small-star rounds of grouped minima and joins, hubs' edges dealt among the tasks. Every
    round is checkpointed in the shared folder.
    """
    shared_dir(edges.sparkSession)
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    seen = print_of(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("u", "m"))
        large = join_hot(both.filter("v > u"), low, "u", 2 * seen[0], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = join_hot(large, low, "u", seen[0], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = small.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        was, seen = seen, print_of(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v"), F.col("v")).distinct()
    )

"""Token ids in binary blocks coded by range asymmetric numeral systems (rANS).

One static frequency table over all ids serves every block. A block holds whole documents in ascending doc_id order
and is coded on its own: symbols go round LANES interleaved states, and every CHECKPOINT steps the states and the
place in the stream are kept with a checksum of the symbols up to the next one, so a reader can start there. A block
is one row of a Parquet file, so files are committed or retried as Spark does it and blocks are read in parallel.

Block layout, little-endian: magic "EVR1", u32 lanes, u64 symbols, u32 documents, u32 checkpoints, u64 words; then
documents' ids (i64), a byte each for null ids, counts (u64); checkpoints' word offsets (u64), checksums (u32) and
states (u64 x lanes); the words (u32); last a u32 crc of all before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evistra.llm._common import materialize, packed, shared_folder, slices, text_column, unpacked
from evistra.llm.bpe import by_size, default_path, distinct_words, keys_in, no_cycle_search, rows_of, word_ids

END_ID = 2
LANES, CHECKPOINT, BLOCK_SYMBOLS, SHARD_SYMBOLS, BITS = 512, 128, 1 << 18, 1 << 23, 20
#: Shards whose offsets, 16 bytes each, are broadcast to the reader; beyond it they are joined.
BROADCAST_SHARDS = 1 << 20
_HEAD = struct.Struct("<4sIQIIQ")
_LOW, _MASK, _WORD = np.uint64(1 << 31), np.uint64((1 << BITS) - 1), np.uint64(0xFFFFFFFF)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, counts) of whole texts with END_ID after each; ids are packed for the disk and the shuffle.

    Each task adds a row of its own with the counts of its ids, packed, which is null for documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(doc_id: pa.Array, *cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc_id, *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.binary(), pa.binary())))], names=["doc_id", "n_tokens", "ids", "counts"])

        of_key, total = word_ids(path).__getitem__, np.zeros(1, dtype=np.int64)
        for b in by_size(batches, 1):
            with no_cycle_search():
                words, at, n_words = distinct_words(b.column(1))
                keys, n_keys = keys_in(words)
                ids = list(map(of_key, keys.dictionary.to_numpy(zero_copy_only=False).tolist()))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
            own, ends = rows_of(sizes, np.cumsum(sizes) - sizes, keys.indices.to_numpy())
            flat = np.append(np.frombuffer(b"".join(ids), dtype="<u4")[own], np.uint32(END_ID))  # the words' ids, then the end id
            bounds = np.append(np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n_keys)))], len(flat))
            starts, sizes = bounds[:-1], np.diff(bounds)
            at = np.insert(at, np.cumsum(n_words), len(words))  # the end id after each text
            n_words, stop = n_words + 1, 0
            for part, n in zip(slices(iter([b])), np.split(n_words, range(128, len(n_words), 128))):
                begin, stop = stop, stop + int(n.sum())
                own, ends = rows_of(sizes, starts, at[begin:stop])
                own = flat[own]
                counts = np.bincount(own)
                if len(counts) > len(total):
                    total = np.pad(total, (0, len(counts) - len(total)))
                total[: len(counts)] += counts
                bounds = [0, *ends[np.cumsum(n) - 1].tolist()]
                yield rows(part.column(0), np.diff(bounds).tolist(), [packed(own[i:j]) for i, j in pairwise(bounds)], [None] * len(n))
        if total.any():
            yield rows(pa.array([None], pa.int64()), [None], [None], [packed(total, "<u8")])

    return docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """The shared table: each id's share of 2 ** BITS, at least 1 where it occurs; and the number of all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                total = unpacked(x, "<u8").astype(np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    rows = tokens.select("counts").filter("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    if not len(ids):
        return np.zeros(1, dtype=np.uint64), 0
    counts = np.zeros(ids.max() + 1, dtype=np.int64)
    counts[ids] = n
    share = np.where(counts > 0, np.maximum(1, counts * (1 << BITS) // counts.sum()), 0)
    while (over := int(share.sum()) - (1 << BITS)) != 0:  # take from, or give to, the most frequent
        top = np.argsort(-share, kind="stable")[: max(1, min(abs(over), int((share > 1).sum())))]
        share[top] -= np.sign(over)
    return share.astype(np.uint64), int(counts.sum())


def encode_block(symbols: np.ndarray, ids: list[int | None], counts: list[int], freq: np.ndarray, cum: np.ndarray) -> bytes:
    n = len(symbols)
    lanes = max(1, min(LANES, n))
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, dtype=np.uint64)
    f_all, c_all = freq[symbols], cum[symbols]
    words: list[np.ndarray] = []
    emitted, marks = 0, []
    for s in range(steps - 1, -1, -1):
        f, c = f_all[s * lanes : (s + 1) * lanes], c_all[s * lanes : (s + 1) * lanes]
        y = x[: len(f)]
        full = np.flatnonzero(y >= f << np.uint64(63 - BITS))
        if len(full):
            words.append((y[full] & _WORD).astype("<u4"))
            emitted += len(full)
            y[full] >>= np.uint64(32)
        q, r = np.divmod(y, f)
        y[:] = (q << np.uint64(BITS)) + r + c
        if s % CHECKPOINT == 0:
            part = symbols[s * lanes : (s + CHECKPOINT) * lanes]
            marks.append((emitted, zlib.crc32(part.astype("<u4").tobytes()), x.copy()))
    marks.reverse()
    out = [
        _HEAD.pack(b"EVR1", lanes, n, len(ids), len(marks), emitted),
        np.array([i or 0 for i in ids], dtype="<i8").tobytes(), bytes(i is None for i in ids), np.array(counts, dtype="<u8").tobytes(),
        np.array([emitted - m[0] for m in marks], dtype="<u8").tobytes(), np.array([m[1] for m in marks], dtype="<u4").tobytes(),
        b"".join(m[2].astype("<u8").tobytes() for m in marks), b"".join(w.tobytes() for w in reversed(words)),
    ]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray, part: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, counts, symbols); with part, only the symbols from that checkpoint to the next."""
    if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block's checksum doesn't fit")
    magic, lanes, n, docs, marks, n_words = _HEAD.unpack_from(block)
    if magic != b"EVR1":
        raise ValueError("not a token block")
    at = _HEAD.size

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(block, dtype=kind, count=k, offset=at)
        at += x.nbytes
        return x

    ids, null, counts = take("<i8", docs), take("u1", docs), take("<u8", docs)
    offsets, sums, states, words = take("<u8", marks), take("<u4", marks), take("<u8", marks * lanes).reshape(marks, lanes), take("<u4", n_words)
    out = []
    for k in range(marks) if part is None else [part]:
        x, pos = states[k].astype(np.uint64), int(offsets[k])
        got = np.empty(min(n - k * CHECKPOINT * lanes, CHECKPOINT * lanes), dtype=np.uint32)
        for a in range(0, len(got), lanes):
            y = x[: min(lanes, len(got) - a)]
            slot = y & _MASK
            sym = slots.take(slot.view(np.int64)).astype(np.intp)
            got[a : a + lanes] = sym
            y >>= np.uint64(BITS)
            y *= freq.take(sym)
            y += slot
            y -= cum.take(sym)
            low = np.flatnonzero(y < _LOW)
            if len(low):
                y[low] = (y[low] << np.uint64(32)) | words[pos : pos + len(low)]
                pos += len(low)
        if zlib.crc32(got.astype("<u4").tobytes()) != sums[k]:
            raise ValueError("a checkpoint's checksum doesn't fit")
        out.append(got)
    return [None if z else int(i) for i, z in zip(ids, null)], counts, np.concatenate(out) if out else np.empty(0, np.uint32)


def tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slot of each id, and the id of each slot."""
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    return cum, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Encode all documents and write `folder`/blocks and `folder`/table, in ascending doc_id order (null first)."""
    spark = docs.sparkSession
    tokens = materialize(token_ids(docs, path or default_path()), "tokens")
    freq, total = frequencies(tokens)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, share long").coalesce(1).write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        cum, _ = tables(freq)
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        counts: list[int] = []

        def block() -> pa.RecordBatch:
            nonlocal number, start, ids, parts, counts
            n = sum(counts)
            row = {"shard": shard, "block": number, "start": start, "first_doc": ids[0], "n_tokens": n, "payload": encode_block(np.concatenate(parts), ids, counts, freq, cum)}
            number, start, ids, parts, counts = number + 1, start + n, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("first_doc", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                parts.append(unpacked(x))
                counts.append(len(parts[-1]))
                if sum(counts[-1:]) >= BLOCK_SYMBOLS or len(counts) % 16 == 0 and sum(counts) >= BLOCK_SYMBOLS:
                    yield block()
        if ids:
            yield block()

    own = tokens.filter("counts is null").select("doc_id", "ids", F.xxhash64("ids").alias("mark"))  # a doc_id that repeats may fill more than a shard
    ordered = own.repartitionByRange(max(1, -(-total // SHARD_SYMBOLS)), "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "ids")
    ordered.select("doc_id", "ids").mapInArrow(run, "shard int, block long, start long, first_doc long, n_tokens long, payload binary").write.parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts the ids of all documents before."""
    rows = spark.read.parquet(f"{folder}/table").toArrow().to_pydict()
    freq = np.zeros(max(rows["id"], default=0) + 1, dtype=np.uint64)
    freq[rows["id"]] = rows["share"]
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema("shard int, block long, start long, first_doc long, n_tokens long, payload binary").parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared.value
        cum, slots = tables(freq)
        for b in batches:
            for shard, start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids, counts, symbols = decode_block(payload.as_py(), freq, cum, slots)
                ends = np.cumsum(counts).astype(np.int64)
                begins = ends - counts.astype(np.int64)
                raw = symbols.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(begins + start), pa.array(counts.astype(np.int64)), pa.array([raw[i:j].tobytes() for i, j in zip(begins, ends)], pa.binary())],
                    names=["shard", "doc_id", "within", "n_tokens", "ids"],
                )

    docs = blocks.select("shard", "start", "payload").mapInArrow(run, "shard int, doc_id long, within long, n_tokens long, ids binary")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # as long as shards are few their offsets go to the ids, not the ids to them
    few = F.broadcast(before) if shards.count() <= BROADCAST_SHARDS else before
    return docs.join(few, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")


def blocks_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """What the files hold of each document.

    A null text is empty and holds the end id alone; rows with equal doc_ids follow one another, ordered by a hash of their ids;
    rows with a null doc_id come first.
    """
    folder = shared_folder(docs.sparkSession, "blocks")
    write_tokens(docs, folder, path)
    found = read_tokens(docs.sparkSession, folder)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

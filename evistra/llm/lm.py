"""N-gram language model in a log-frequency Bloom filter.

One pass turns the texts into runs: a few megabytes of consecutive texts as numbers, with the hashes of the run's
different words. Counts of words, of bigrams, and of each word's distinct followers are made from the runs, dealt by
hash to buckets and merged there. They are quantised on a logarithmic scale, and a count of level q puts (n-gram, 1)
to (n-gram, q) into the bucket's Bloom filter; a reader probes levels until one is missing. A bucket's filter is as
large as its entries need and the number of buckets follows the corpus, so no n-gram is left out at any size. The
filter stays in rows: instead of a broadcast of all of it, runs send their different n-grams to the buckets and get
the levels back. Probabilities are interpolated absolute discounting, the discount estimated from the corpus' counts
of counts, over the same additive word model as the base score, whose exact word counts come with the answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import batches_of, groups, materialize, packed, slices, text_column, unpacked

#: Bytes of texts in a run, tokens for which a bucket is meant, the least number of buckets as a power of 2.
RUN_BYTES, BUCKET_TOKENS, LEAST_BITS = 6 << 20, 1 << 19, 8
#: Bigrams that a task counts before it passes them on; tokens for each task after a shuffle.
HELD_PAIRS, TASK_TOKENS = 4 << 20, 2 << 20
#: Hashes per entry, base of the levels.
HASHES, BASE = 4, 1.25
#: The end of a text as a token, and the place before the first word; neither can be a word.
END, START = b"\n", b""
WORDS, FOLLOWERS, BIGRAMS = 0, 1, 2
#: Stand in a run's place: a bucket's own rows.
_COUNTS, _FOLLOW, _EXACT = -3, -2, -1
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_A, _B, _LOW = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xFFFFFFFF)
_LEVELS = np.unique(np.ceil(BASE ** np.arange(220)).astype(np.float64))[:150]  # least count of each level
_MEAN = np.concatenate(([0.0], (_LEVELS[:-1] + np.maximum(_LEVELS[:-1], _LEVELS[1:] - 1)) / 2, _LEVELS[-1:]))  # count read back


# --- n-grams as numbers ----------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every number comes from exactly one."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What mix made x from."""
    a, b = (np.uint64(pow(int(m), -1, 1 << 64)) for m in (_A, _B))
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * b
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * a
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def item_of(key: np.ndarray, kind: int) -> np.ndarray:
    """The n-gram's item, one to one: its first bits name the bucket, the next 32 the entry in the bucket's filter."""
    return mix(key ^ _SALT[kind])


def history(h: np.ndarray) -> np.ndarray:
    """The item by which a word's followers are found; the word itself lies in the same bucket."""
    return item_of(h >> np.uint64(32), FOLLOWERS)


def word_low(h: np.ndarray) -> np.ndarray:
    return (item_of(h, WORDS) >> np.uint64(32)).astype("<u4")


def word_order(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words by bucket and hash, and their buckets in that order."""
    bucket = (history(h) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((h, bucket))
    return order, bucket[order]


def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """32 bits of either word's hash."""
    return (before & ~_LOW) | (word >> np.uint64(32))


def low_of(item: np.ndarray, bits: int) -> np.ndarray:
    return ((item << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, with the sums of their n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def cuts_of(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, where) of sorted buckets."""
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
    for a, b in zip(first, np.append(first[1:], len(bucket))):
        yield int(bucket[a]), slice(a, b)


def by_bucket(items: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(bucket, where) of sorted items."""
    return cuts_of((items >> np.uint64(64 - bits)).astype(np.int64))


def rising(x: np.ndarray, kind: str = "<u8") -> bytes:
    """Sorted numbers for the shuffle, by their differences."""
    x = x.astype(kind)
    return packed(np.concatenate((x[:1], x[1:] - x[:-1])), kind)


def risen(row: bytes, kind: str = "<u8") -> np.ndarray:
    return np.cumsum(unpacked(row, kind), dtype=kind)


# --- the filter ------------------------------------------------------------------------------------------------------


def level_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_LEVELS, n, side="right")


def halves(low: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of (entry, level), combined for every further one."""
    g = (low + np.uint64(level << 32)) * _A
    g ^= g >> np.uint64(29)
    g *= _B
    return g >> np.uint64(32), (g & _LOW) | np.uint64(1)


def position(a: np.ndarray, b: np.ndarray, i: int, size: int) -> np.ndarray:
    """Bit of the i-th hash among size bits."""
    return (((((a + np.uint64(i) * b) & _LOW) * np.uint64(size)) >> np.uint64(32))).astype(np.int64)


def filled(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes of a filter in which the entries have the levels of their counts; half of its bits are set."""
    level, low = level_of(n), low.astype(np.uint64)
    size = max(64, -(-int(level.sum() * HASHES / np.log(2)) // 8) * 8)
    on = np.zeros(size, dtype=bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        a, b = halves(low[level >= j], j)
        for i in range(HASHES):
            on[position(a, b, i, size)] = True
    return np.packbits(on, bitorder="little")


def probe(bits: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The highest level up to which all are present, probed one by one."""
    found, low, size = np.zeros(len(low), dtype=np.uint8), low.astype(np.uint64), 8 * len(bits)
    live = np.arange(len(low))
    for j in range(1, len(_LEVELS) + 1):
        a, b = halves(low[live], j)
        for i in range(HASHES):
            at = position(a, b, i, size)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, a, b = live[hit], a[hit], b[hit]
        if not len(live):
            break
        found[live] = j
    return found


# --- texts to runs ---------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Held out of the training: crc32 of doc_id as text, mod 5, is 1; rows without a doc_id train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


class Vocabulary(dict):
    """word -> index, in the order in which words are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def in_runs(docs: DataFrame) -> DataFrame:
    """One row for each run of RUN_BYTES of texts (a longer text is a run of its own).

    (run, doc_id, held, lens, docs, tokens, hash, at): by document its id, whether it is held out, and its tokens with
    the end; how many documents and tokens train; hashes of the different words, the end first and START (0) second;
    all tokens as indices.
    """
    own = docs.select(F.col("doc_id").cast("long"), held_out(docs["doc_id"]).alias("held"), text_column(docs).alias("text"))
    own = own.withColumn("part", F.spark_partition_id())

    def row(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        index = Vocabulary({END: 0, START: 1})
        lens, parts = [], []
        for text in batches_of(rows.column("text")):
            words = text.lower().split()  # of bytes: A-Z and ASCII white space only
            words.append(END)
            lens.append(len(words))
            parts.append(np.fromiter(map(index.__getitem__, words), dtype="<u4", count=len(words)))
        out = rows.column("held").to_numpy()
        n = np.array(lens)
        digest = np.array([xxhash.xxh64_intdigest(w) for w in index], dtype="<u8")
        digest[1] = 0
        lists = [pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), x) for x in (rows.column("doc_id").chunk(0), rows.column("held").chunk(0), pa.array(n, pa.int64()))]
        train = int((~out).sum()), int(n[~out].sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *lists, *(pa.array([x]) for x in train), pa.array([digest.tobytes()]), pa.array([packed(np.concatenate(parts))])],
            names=["run", "doc_id", "held", "lens", "docs", "tokens", "hash", "at"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = None, [], 0
        for b in slices(batches):
            if not b.num_rows:
                continue
            number = b.column("part")[0].as_py() << 32 if number is None else number
            held.append(b)
            size += b.column("text").nbytes
            if size > RUN_BYTES:
                yield row(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield row(number, held)

    return own.mapInArrow(run, "run long, doc_id array<long>, held array<boolean>, lens array<long>, docs long, tokens long, hash binary, at binary")


class Run:
    """The tokens of a run and of each the token before it, START where a text begins."""

    def __init__(self, b: pa.RecordBatch | pa.Table, i: int):
        self.lens = np.array(b.column("lens")[i].as_py(), dtype=np.int64)
        self.hash = np.frombuffer(b.column("hash")[i].as_py(), dtype="<u8")
        self.at = unpacked(b.column("at")[i].as_py()).astype(np.int64)
        self.begins = np.cumsum(self.lens) - self.lens
        self.before = np.concatenate(([1], self.at[:-1]))
        self.before[self.begins] = 1

    def pairs(self) -> np.ndarray:
        """Item of each token with the one before."""
        return item_of(bigram(self.hash[self.before], self.hash[self.at]), BIGRAMS)


# --- training --------------------------------------------------------------------------------------------------------


def counted(runs: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, keys, n): the training texts' words (by hash) and bigrams (by item) with their counts, a task's together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORDS: [], BIGRAMS: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, some in held.items():
                keys, n = summed(*(np.concatenate(x) for x in zip(*some))) if some else (np.empty(0, np.uint64), np.empty(0, np.int64))
                some.clear()
                if kind == WORDS:
                    order, bucket = word_order(keys, bits)
                    keys, n, parts = keys[order], n[order], cuts_of(bucket)
                else:
                    parts = by_bucket(keys, bits)
                for bucket, at in parts:
                    cols = [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([rising(keys[at])], pa.binary()), pa.array([packed(n[at], "<i8")], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["kind", "bucket", "keys", "n"])

        for b in batches:
            for i in range(b.num_rows):
                r = Run(b, i)
                train = np.repeat(~np.array(b.column("held")[i].as_py(), dtype=bool), r.lens)
                pairs = r.pairs()[train]
                held[BIGRAMS].append(summed(pairs, np.ones(len(pairs), dtype=np.int64)))
                n = np.bincount(r.at[train], minlength=len(r.hash)).astype(np.int64)
                held[WORDS].append((r.hash[n > 0], n[n > 0]))
                size += len(held[BIGRAMS][-1][0])
                if size > HELD_PAIRS:
                    yield from flush()
                    size = 0
        yield from flush()

    return runs.select("held", "lens", "hash", "at").mapInArrow(count, "kind int, bucket int, keys binary, n binary")


def merged(counts: DataFrame, bits: int, parts: int) -> DataFrame:
    """(what, kind, bucket, keys, n, types, once, twice) of each bucket, its counts added up.

    what: `filter`, the bucket's bits in keys and in types, once and twice how many n-grams it holds, how many with a
    count of 1 and of 2; `exact`, the words' hashes and counts; `follow`, entries of histories and how many bigrams of
    the bucket begin with them, dealt by the histories' buckets.
    """
    names = ["what", "kind", "bucket", "keys", "n", "types", "once", "twice"]

    def row(what: str, kind: int, bucket: int, keys: bytes, n: np.ndarray | None, *stats: int) -> pa.RecordBatch:
        cols = [pa.array([what]), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([keys], pa.binary()), pa.array([None if n is None else packed(n, "<i8")], pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array([x], pa.int64()) for x in (stats or (None,) * 3))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), g in groups(batches, ["kind", "bucket"]):
            keys = np.concatenate([risen(x) for x in g.column("keys").to_pylist()])
            keys, n = summed(keys, np.concatenate([unpacked(x, "<i8") for x in g.column("n").to_pylist()]))
            low = word_low(keys) if kind == WORDS else low_of(keys, bits)
            yield row("filter", kind, bucket, filled(low, n).tobytes(), None, len(keys), int((n == 1).sum()), int((n == 2).sum()))
            if kind == WORDS:
                yield row("exact", kind, bucket, rising(keys), n)
            else:
                before, follow = np.unique((unmix(keys) ^ _SALT[BIGRAMS]) >> np.uint64(32), return_counts=True)
                item, follow = summed(item_of(before, FOLLOWERS), follow.astype(np.int64))
                for to, at in by_bucket(item, bits):
                    yield row("follow", FOLLOWERS, to, rising(low_of(item[at], bits), "<u4"), follow[at])

    dealt = counts.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(run, "what string, kind int, bucket int, keys binary, n binary, types long, once long, twice long")


class Model:
    """What every worker gets: totals of the corpus, the discount, the number of buckets as a power of 2 and of tasks."""

    def __init__(self, texts: int, tokens: int, types: int, discount: float, bits: int, parts: int):
        self.texts, self.tokens, self.types, self.discount, self.bits, self.parts = texts, tokens, types, discount, bits, parts


class Filter:
    """The buckets in rows: (kind, bucket, bits) of the filter, and (bucket, keys, n) of the exact word counts."""

    def __init__(self, bits: DataFrame, exact: DataFrame):
        self.bits, self.exact = bits, exact


def train(runs: DataFrame) -> tuple[Model, Filter]:
    """The model of the runs' training texts."""
    total = runs.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    bits = max(LEAST_BITS, (max(1, total["tokens"] // BUCKET_TOKENS) - 1).bit_length())
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total["tokens"] // TASK_TOKENS)
    rows = materialize(merged(counted(runs, bits), bits, parts), "lm-counts", by="what")
    size = {r["kind"]: r for r in rows.filter("what = 'filter'").groupBy("kind").agg(F.sum("types").alias("types"), F.sum("once").alias("once"), F.sum("twice").alias("twice")).collect()}
    once, twice = (size[BIGRAMS]["once"], size[BIGRAMS]["twice"]) if BIGRAMS in size else (0, 0)
    discount = once / (once + 2 * twice) if once else 0.5

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), g in groups(batches, ["bucket"]):
            low = np.concatenate([risen(x, "<u4") for x in g.column("keys").to_pylist()])
            low, n = summed(low, np.concatenate([unpacked(x, "<i8") for x in g.column("n").to_pylist()]))
            yield pa.RecordBatch.from_arrays([pa.array([FOLLOWERS], pa.int32()), pa.array([bucket], pa.int32()), pa.array([filled(low, n).tobytes()], pa.binary())], names=["kind", "bucket", "keys"])

    followers = rows.filter("what = 'follow'").select("bucket", "keys", "n").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(follow, "kind int, bucket int, keys binary")
    found = rows.filter("what = 'filter'").select("kind", "bucket", "keys").union(followers)
    model = Model(total["docs"], total["tokens"], size[WORDS]["types"] if WORDS in size else 0, discount, bits, parts)
    return model, Filter(found, rows.filter("what = 'exact'").select("bucket", "keys", "n"))


# --- scoring ---------------------------------------------------------------------------------------------------------


def asked(r: Run, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a run asks: its words' order, its different bigrams' items in order, and where each token's bigram is among them."""
    return word_order(r.hash, bits)[0], *np.unique(r.pairs(), return_inverse=True)


def requests(runs: DataFrame, bits: int) -> DataFrame:
    """(kind, bucket, run, data): the words, by hash, and the bigrams, by entry, that a run asks each bucket for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r, number = Run(b, i), b.column("run")[i].as_py()
                order, bucket = word_order(r.hash, bits)
                items = np.unique(r.pairs())
                got = [(WORDS, k, rising(r.hash[order[at]])) for k, at in cuts_of(bucket)] + [(BIGRAMS, k, rising(low_of(items[at], bits), "<u4")) for k, at in by_bucket(items, bits)]
                cols = [pa.array([x[k] for x in got], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*cols[:2], pa.array([number] * len(got), pa.int64()), cols[2]], names=["kind", "bucket", "run", "data"])

    return runs.select("run", "lens", "hash", "at").mapInArrow(run, "kind int, bucket int, run long, data binary")


def answers(runs: DataFrame, found: Filter, bits: int, parts: int) -> DataFrame:
    """(run, kind, bucket, levels, exact): the levels of what each run asks each bucket for; of words the levels of their
    counts, then of their followers, and the exact counts. What is asked of a bucket together is probed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for b in batches:
            out: list[tuple] = []
            rows = zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "run", "data", "n")))
            for (kind, bucket), some in groupby(rows, key=lambda x: x[:2]):
                if at != (kind, bucket):  # the bucket's own rows stand before what is asked of it
                    at, own = (kind, bucket), {}
                asks = []
                for _, _, number, data, extra in some:
                    if number >= 0:
                        asks.append((number, risen(data, "<u8" if kind == WORDS else "<u4")))
                    else:
                        own[number] = (risen(data), unpacked(extra, "<i8")) if number == _EXACT else np.frombuffer(data, dtype=np.uint8)
                if not asks:
                    continue
                keys, ends = np.concatenate([x for _, x in asks]), np.cumsum([len(x) for _, x in asks])
                level = lambda low, which: probe(own[which], low) if which in own else np.zeros(len(low), np.uint8)
                if kind == WORDS:
                    count, follow, exact = level(word_low(keys), _COUNTS), level(low_of(history(keys), bits), _FOLLOW), np.zeros(len(keys), dtype="<i8")
                    known, n = own.get(_EXACT, (keys[:0], exact[:0]))
                    where = np.searchsorted(known, keys)
                    there = where < len(known)
                    there[there] = known[where[there]] == keys[there]
                    exact[there] = n[where[there]]
                else:
                    count = level(keys, _COUNTS)
                for (number, x), end in zip(asks, ends):
                    cut = slice(end - len(x), end)
                    levels = np.concatenate((count[cut], follow[cut])) if kind == WORDS else count[cut]
                    out.append((number, kind, bucket, packed(levels, "u1"), packed(exact[cut], "<i8") if kind == WORDS else None))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=["run", "kind", "bucket", "levels", "exact"])

    nothing = F.lit(None).cast("binary").alias("n")
    kind = F.when(F.col("kind") == FOLLOWERS, WORDS).otherwise(F.col("kind")).alias("kind")
    number = F.when(F.col("kind") == FOLLOWERS, _FOLLOW).otherwise(_COUNTS).cast("long").alias("run")
    own = found.bits.select(kind, "bucket", number, F.col("keys").alias("data"), nothing)
    exact = found.exact.select(F.lit(WORDS).alias("kind"), "bucket", F.lit(_EXACT).cast("long").alias("run"), F.col("keys").alias("data"), "n")
    every = own.union(exact).union(requests(runs, bits).select("*", nothing))
    every = every.repartition(parts, "kind", "bucket").sortWithinPartitions("kind", "bucket", "run")
    return every.mapInArrow(run, "run long, kind int, bucket int, levels binary, exact binary")


def scores(r: Run, levels: list[np.ndarray], exact: np.ndarray, model: Model) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of the run's texts, from the levels of its words, histories and bigrams."""
    count, follow, n = (_MEAN[x] for x in levels)
    rest = model.tokens + 0.5 * (model.types + 1)
    word = (count + 0.5) / rest
    count = count.copy()
    count[1] = model.texts  # START: a text begins as often as one ends
    # a history's count is at least its number of different followers
    seen = np.maximum(np.where(follow > 0, count, 0.0), follow)
    share = np.where(seen > 0, np.clip(model.discount * follow / np.maximum(seen, 1e-9), 1e-3, 1.0), 1.0)  # of the word model
    a, b = r.before, r.at
    p = np.maximum(np.minimum(n, seen[a]) - model.discount, 0.0) / np.maximum(seen[a], 1e-9)
    p = np.log10(np.minimum(p + share[a] * word[b], 1.0))
    base = np.log10((exact + 0.5) / rest)[b]
    return [r.lens, np.add.reduceat((exact > 0).astype(np.int64)[b], r.begins), np.add.reduceat(base, r.begins), np.add.reduceat(p, r.begins)]


def lm_report(docs: DataFrame) -> DataFrame:
    """Base and model scores of every document.

    A null text is empty: its only token is the end. Repeated rows count again in training and are scored alike.
    An empty table gives no rows; where all rows are held out, the model is empty and every word unknown. Rows
    without a doc_id train and are scored. A text of any length is a run, or part of one, as a whole.
    """
    spark = docs.sparkSession
    runs = materialize(in_runs(docs), "lm-runs")
    model, found = train(runs)
    shared, bits = spark.sparkContext.broadcast(model), model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["run"]):
            own, got = rows.slice(rows.num_rows - 1), rows.slice(0, rows.num_rows - 1)  # by kind and bucket, the run itself last
            r = Run(own, 0)
            order, _, where = asked(r, bits)
            words, pairs = (got.filter(pa.compute.equal(got.column("kind"), k)) for k in (WORDS, BIGRAMS))
            both = [unpacked(x, "u1").reshape(2, -1) for x in words.column("levels").to_pylist()]
            count, follow, exact = (np.empty(len(order), dtype=np.int64) for _ in range(3))
            count[order], follow[order] = np.concatenate(both, axis=1)
            exact[order] = np.concatenate([unpacked(x, "<i8") for x in words.column("exact").to_pylist()])
            level = np.concatenate([unpacked(x, "u1") for x in pairs.column("levels").to_pylist()])
            cols = scores(r, [count, follow, level[where]], exact, shared.value)
            ids = [own.column(c).combine_chunks().flatten() for c in ("doc_id", "held")]
            out = pa.table([*ids, *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
            yield from out.to_batches(max_chunksize=4096)

    both = answers(runs, found, bits, model.parts).unionByName(runs.select("run", "doc_id", "held", "lens", "hash", "at"), allowMissingColumns=True)
    both = both.repartition(model.parts, "run").sortWithinPartitions("run", F.asc_nulls_last("kind"), "bucket")
    scored = both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")

"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

Each task of a first pass over all texts sums up its pre-tokens in a summary of bounded size; summaries are merged in
levels into one, and its most frequent pre-tokens, encoded once each, become a compact hash table of lengths that is
broadcast. A second pass adds up the lengths of every text: a worker's cache answers for the pieces it has seen, the
table for frequent pre-tokens, and the tokenizer for the rest. The table steers speed only; no count depends on it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import slices, text_column
from evistra.llm.bpe import _BYTE_CHARS, no_cycle_search, tokenizer

#: Tokens beyond which a document is over the limit.
LIMIT = 1024
#: Pre-tokens of the broadcast table and of a summary, UTF-8 bytes of each at most: the table stays under some 3 MB.
TABLE_KEYS, KEY_BYTES = 65_536, 32
#: Different pieces that a task counts before it thins its summary; pieces in one generation of a worker's cache.
COUNTED, CACHED = 200_000, 400_000
#: Summaries that one task merges.
FAN_IN = 16

_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_LOOSE = re.compile(f" [{_WHITE}]")
_AS_IS = "\ud800"  # in no text: it can't be written in UTF-8
_LOOSE_ASCII = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")
#: Characters whose classes no version of Unicode has changed; pieces of others go to the tokenizer whole.
_SETTLED = regex.compile("[\\x00-\\x1b!-\\x7f \\xa0-\\u017f\\u2013\\u2014\\u2018-\\u201e\\u2026\\u20ac]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pieces_of(text: str) -> list[str]:
    """The text in pieces at which pre-tokens always begin, each after the first without the one space it begins with.

    Pre-tokens never reach from a visible character to white space, and take at most the last space before a word with
    them. Where no space comes before other white space, each space therefore begins a piece.
    """
    if any(map(text.__contains__, _LOOSE_ASCII)) if text.isascii() else _LOOSE.search(text):
        found = _PIECE.findall(text)
        # the same form: a first piece, and pieces after a space
        return ["", *(p[1:] if p[0] == " " else _AS_IS + p for p in found)]
    return text.split(" ")


def piece_text(piece: str) -> str:
    """What a piece after the first stands for: itself behind a space, or, where marked so, itself as it is."""
    return piece[1:] if piece[:1] == _AS_IS else " " + piece


class LengthTable:
    """A compact hash table from pre-tokens to their token counts: open addressing over flat arrays.

    The pre-tokens' bytes lie end to end and are compared on each probe, so an answer is never another pre-token's.
    """

    def __init__(self, lengths: dict[bytes, int]):
        keys = list(lengths)
        self.bytes = b"".join(keys)
        self.ends = np.cumsum([0, *map(len, keys)], dtype=np.uint32)
        self.lengths = np.array([lengths[k] for k in keys], dtype=np.uint16)
        self.mask = (1 << max(4, (2 * len(keys)).bit_length())) - 1
        self.slots = np.zeros(self.mask + 1, dtype=np.uint32)
        for i, k in enumerate(keys):
            at = xxhash.xxh3_64_intdigest(k) & self.mask
            while self.slots[at]:
                at = at + 1 & self.mask
            self.slots[at] = i + 1

    def views(self) -> LengthTable:
        """With plain views of the arrays, which answer single lookups quicker."""
        self.slot, self.end, self.length = memoryview(self.slots), memoryview(self.ends), memoryview(self.lengths)
        return self

    def get(self, key: bytes) -> int | None:
        at = xxhash.xxh3_64_intdigest(key) & self.mask
        while i := self.slot[at]:
            if self.bytes[self.end[i - 1] : self.end[i]] == key:
                return self.length[i - 1]
            at = at + 1 & self.mask
        return None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("slot", "end", "length")}


@lru_cache(maxsize=2)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def pretokens(piece: str, pattern: str) -> list[str] | None:
    """Pre-tokens of a piece's text; None where only the tokenizer can tell (special strings, unsettled characters)."""
    if "<|" in piece or not _SETTLED.fullmatch(piece):
        return None
    return _pattern(pattern).findall(piece)


class Counts(dict):
    """piece -> its number of tokens, in two generations of bounded size."""

    def __init__(self, path: str, pattern: str, table: LengthTable):
        self.tokenizer, self.pattern, self.table = tokenizer(path), pattern, table.views()
        self.model = self.tokenizer.model
        self.old: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.of(piece_text(piece))
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n

    def of(self, text: str) -> int:
        found = pretokens(text, self.pattern)
        if found is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total = 0
        for p in found:
            key = p.encode()
            n = self.table.get(key) if len(key) <= KEY_BYTES else None
            total += len(self.model.tokenize(key.decode("latin-1").translate(_BYTE_CHARS))) if n is None else n
        return total

    def of_document(self, text: str) -> int:
        first, *rest = pieces_of(text)
        return sum(map(self.__getitem__, rest)) + (self.of(first) if first else 0)


def _thinned(counts: Counter, keep: int) -> Counter:
    return counts if len(counts) <= keep else Counter(dict(sorted(counts.items(), key=lambda t: (-t[1], t[0]))[:keep]))


_SUMMARY = "keys array<string>, n array<long>"


def _summary(counts: Counter, keep: int) -> pa.RecordBatch:
    rows = sorted(counts.items(), key=lambda t: (-t[1], t[0]))[:keep]
    return pa.RecordBatch.from_arrays([pa.array([[k for k, _ in rows]], pa.list_(pa.string())), pa.array([[n for _, n in rows]], pa.list_(pa.int64()))], names=["keys", "n"])


def frequent_pretokens(docs: DataFrame, pattern: str, keep: int = TABLE_KEYS) -> list[str]:
    """About the `keep` most frequent pre-tokens of all texts, from summaries of `keep` pre-tokens at most.

    A task reads all its texts and keeps what it has counted most; summaries are merged FAN_IN at a time, level by level.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Counter = Counter()
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                pieces.update(pieces_of(text)[1:])
            if len(pieces) > 2 * COUNTED:
                pieces = _thinned(pieces, COUNTED)
        found: Counter = Counter()
        for piece, n in _thinned(pieces, COUNTED).items():
            for p in pretokens(piece_text(piece), pattern) or ():
                if len(p) <= KEY_BYTES // 2 or len(p.encode()) <= KEY_BYTES:
                    found[p] += n
        if found:
            yield _summary(found, keep)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in slices(batches, 1):
            for k, c in zip(b.column(0).flatten().to_pylist(), b.column(1).flatten().to_pylist()):
                total[k] += c
            total = _thinned(total, 2 * keep)
        if total:
            yield _summary(total, keep)

    texts = docs.select(text_column(docs).alias("text"))
    level, left = texts.mapInArrow(count, _SUMMARY), texts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        level = level.repartition(left).mapInArrow(merge, _SUMMARY)
    return [k for row in level.collect() for k in row["keys"]]  # one row


def length_table(keys: list[str], path: str) -> LengthTable:
    """The pre-tokens' token counts, each encoded once."""
    model = tokenizer(path).model
    return LengthTable({k.encode(): len(model.tokenize(k.encode().decode("latin-1").translate(_BYTE_CHARS))) for k in keys})


def count_tokens(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): UTF-8 bytes and tokens of every whole text, as the tokenizer counts them.

    `path` names a byte-level BPE file, `pattern` the pattern of its pre-tokens. No special tokens are added; special
    strings inside texts are the special tokens they name. A null or empty text has no bytes and no tokens. Repeated
    rows and null doc_ids are counted like any other; other columns are not looked at.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    table = docs.sparkSession.sparkContext.broadcast(length_table(frequent_pretokens(docs, pattern), path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(path, pattern, table)
        with no_cycle_search():
            for b in slices(batches):
                n = pa.array(map(counts.of_document, b.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    text = text_column(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


_held: list = []


def _counts(path: str, pattern: str, table) -> Counts:
    """One cache for all tasks of a worker that use the same broadcast table."""
    key = (path, pattern, table.id if hasattr(table, "id") else id(table.value))
    if not _held or _held[0][0] != key:
        _held[:] = [(key, Counts(path, pattern, table.value))]
    return _held[0][1]


def counts_report(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """count_tokens with over_limit, whether a document has more than `limit` tokens."""
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)

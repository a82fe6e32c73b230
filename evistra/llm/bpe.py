"""BPE encoding and decoding through a table of distinct words.

Texts are split at white space, and words into the runs that the tokenizer never merges across ("keys"). Each
distinct key of the corpus is encoded once. The most frequent keys, a bounded number, go to every worker; the rest,
each rare by construction, come back to their places through a join on the key, so no join key is hot. Decoding
looks every id up in the id-to-piece table, whose size the vocabulary file fixes.
"""

from __future__ import annotations

import codecs
import gc
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from tokenizers import Tokenizer

from evistra.llm._common import materialize, packed, slices, text_column, unpacked

#: Keys that are broadcast, words in one generation of a worker's memo of ids, bytes of text whose words are made distinct together.
HEAD_KEYS, MEMO_IDS, CHUNK = 700_000, 500_000, 4 << 20
_ASCII_KEY = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
_SPACE_RE2 = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_ONE_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+|[0-9]|[!-/:-@\[-`{-~]+")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_BYTE_TABLE = "".join(chr(_BYTE_CHARS.get(b, b)) for b in range(256))
_LETTERS = re.compile(r"[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+")
_ENDS = ".,;:!?"  # marks that are one piece in a row and no part of a special token or a contraction
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII's without the apostrophe: in a row they are one piece
_LOWER = "".join(c for c in map(chr, range(0x250)) if _LETTERS.fullmatch(c) and c == c.lower())
_TAIL = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-`{-~]+)", re.S)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def folded(word: str) -> str:
    """A word, lower-cased where that can't change what the tokenizer's own folding gives."""
    if "<|" in word:  # may hold a special token, which is one in lower case only
        return word
    low = word.lower()
    if low == word or word.isascii() or "Σ" not in word and unicodedata.is_normalized("NFC", word) and unicodedata.is_normalized("NFC", low):
        return low
    return word


def keys_of(word: str) -> list[str]:
    """Parts of a word that are encoded on their own; their ids in a row are the word's ids."""
    if "<|" in word:  # may hold a special token
        return [word]
    if word.isascii():
        return _ASCII_KEY.findall(word.lower())
    m = _TAIL.fullmatch(word)
    if m and m[1][-1] < "\u0250" and m[1][-1] != "\u0130":  # a Latin letter that stays one ends a run of letters before ASCII punctuation
        return [m[1], *_ASCII_KEY.findall(m[2])]
    return [word]


def by_size(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about CHUNK bytes of that column of texts."""
    for b in batches:
        sizes = pa.compute.binary_length(b.column(column)).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // CHUNK)) + 1
        for at, end in pairwise([0, *cuts.tolist(), b.num_rows]):
            yield b.slice(at, end - at)
        pa.default_memory_pool().release_unused()  # workers stay for later stages, what they hold would stay with them


def distinct_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct words of the texts, the place of each word of the texts among them, and the number of each text's words.

    Words are parted by white space; white space at an end of a text leaves an empty word there.
    """
    if pa.compute.any(pa.compute.match_substring_regex(texts, f"[{_SEPARATORS}]")).as_py():  # Arrow takes these for white space, the tokenizer doesn't
        lists = pa.compute.split_pattern_regex(texts, _SPACE_RE2)
    else:
        lists = pa.compute.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), pa.compute.list_value_length(lists).to_numpy()


def keys_in(words: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The keys of all words one after another, and the number of each word's keys.

    Most words are letters with or without marks, which are parted all at once; keys_of() parts the others.
    """
    low = pa.compute.ascii_lower(words)
    tails = pa.compute.utf8_ltrim(low, _LOWER)
    size, tail, rest = (pa.compute.binary_length(x).to_numpy() for x in (low, tails, pa.compute.utf8_ltrim(tails, _MARKS)))
    plain = (rest == 0) & (tail < size)
    marked = plain & (tail > 0)
    others = [keys_of(folded(w)) for w in words.filter(pa.array(~plain)).to_numpy(zero_copy_only=False)]
    n = np.ones(len(words), dtype=np.int64)
    n[marked] = 2
    n[~plain] = list(map(len, others))
    starts = np.cumsum(n) - n
    found = pa.concat_arrays([pa.compute.utf8_rtrim(low.filter(pa.array(plain)), _MARKS), tails.filter(pa.array(marked)), pa.array(list(chain.from_iterable(others)), pa.string())])
    place = np.concatenate([starts[plain], starts[marked] + 1, rows_of(n, starts, np.flatnonzero(~plain))[0]])
    coded = found.dictionary_encode()
    keys = np.empty(len(place), dtype=np.int32)
    keys[place] = coded.indices.to_numpy()
    return pa.DictionaryArray.from_arrays(pa.array(keys), coded.dictionary), n


def rows_of(sizes: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of the rows `at` lie, one row after another, in a flat array of rows; and where each row ends among them."""
    n = sizes[at]
    ends = np.cumsum(n, dtype=np.int64)
    return np.repeat(starts[at] - ends + n, n) + np.arange(n.sum()), ends


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """Millions of small objects come and go in such a pass, none of them in a cycle: don't search them for cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class WordIds(dict):
    """word or key -> its ids as unsigned 32-bit little-endian; the ids of a string don't depend on which of both it is.

    Holds up to MEMO_IDS of the present and as many of the generation before, so that frequent ones stay.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            base = word.rstrip(_ENDS)
            if (base.isalpha() and base.islower()) if word.isascii() else _LETTERS.fullmatch(base):
                got = self.piece(word) if base == word else self.of_letters(base) + self.of_key(word[len(base) :])
            else:
                keys = keys_of(word)
                got = self.encoded(keys[0]) if len(keys) == 1 else b"".join(map(self.of_key, keys))
        if len(self) >= MEMO_IDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def of_key(self, key: str) -> bytes:
        """The same for what isn't parted again."""
        got = self.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.encoded(key)
            self[key] = got  # a word follows, which sees to the size
        return got

    def of_letters(self, base: str) -> bytes:
        got = self.get(base) or self.old.get(base) or self.piece(base)
        self[base] = got
        return got

    def encoded(self, key: str) -> bytes:
        if "<|" in key or not _ONE_PIECE.fullmatch(key):
            return array("I", self.tokenizer.encode(key, add_special_tokens=False).ids).tobytes()
        return self.piece(key)

    def piece(self, key: str) -> bytes:
        """Ids of one piece, which the model takes as it is, its bytes written as characters."""
        if not key.isascii():
            key = codecs.charmap_decode(key.lower().encode(), "strict", _BYTE_TABLE)[0]
        return array("I", [x.id for x in self.tokenize(key)]).tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One memo for all tasks of a worker."""
    return WordIds(path)


def key_counts(docs: DataFrame) -> DataFrame:
    """(key, n): the distinct keys of all texts, summed in tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 0):
            with no_cycle_search():
                words, at, _ = distinct_words(b.column(0))
                keys, n_keys = keys_in(words)
            n = np.zeros(len(keys.dictionary), dtype=np.int64)
            np.add.at(n, keys.indices.to_numpy(), np.repeat(np.bincount(at, minlength=len(words)), n_keys))
            yield pa.RecordBatch.from_arrays([keys.dictionary, pa.array(n)], names=["key", "n"])

    parts = docs.select(text_column(docs).alias("text")).mapInArrow(run, "key string, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """(key, n, ids): every distinct key, encoded once; ids are unsigned 32-bit little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = WordIds(path).encoded
        for b in slices(batches, 4096):
            ids = list(map(encoded, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["key", "n", "ids"])

    return materialize(key_counts(docs).mapInArrow(run, "key string, n long, ids binary"), "words")


def frequent(counts: DataFrame, limit: int) -> int:
    """The smallest count at which no more than about `limit` keys remain, from a histogram of 16 steps a doubling."""
    step = F.floor(F.log2("n") * 16).cast("int")
    rows, least = 0, None
    for level, n in sorted(counts.groupBy(step.alias("level")).count().collect(), reverse=True):
        rows += n
        if rows > limit:
            break
        least = level
    return 1 << 62 if least is None else int(np.ceil(2 ** (least / 16) - 1e-9))


class Head:
    """The most frequent keys, found by their hashes in sorted order: some 30 bytes a key, a dict of strings takes six times that."""

    def __init__(self, keys: pa.StringArray):
        self.keys = keys
        hashes = np.fromiter((hash(k) for at in range(0, len(keys), 4096) for k in keys.slice(at, 4096).to_pylist()), np.int64, len(keys))
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.order]
        same = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        self.clashes = {keys[p].as_py(): p for p in self.order[np.union1d(same, same + 1)].tolist()}

    def __reduce__(self) -> tuple:  # strings hash otherwise in another process
        return Head, (self.keys,)

    def find(self, keys: list[str]) -> list[int]:
        """The place of each key, -1 for those that are not here."""
        if not len(self.keys):
            return [-1] * len(keys)
        hashes = np.fromiter(map(hash, keys), np.int64, len(keys))
        place = self.order[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)]
        same = pa.compute.equal(self.keys.take(pa.array(place)), pa.array(keys, pa.string()))
        found = np.where(same.to_numpy(zero_copy_only=False), place, -1).tolist()
        return [self.clashes.get(k, p) for k, p in zip(keys, found)] if self.clashes else found


class Pieces:
    """The id-to-piece table, fixed by the vocabulary file; joins the pieces of ids as the tokenizer does it."""

    def __init__(self, path: str):
        t = tokenizer(path)
        self.piece = np.array([t.id_to_token(i) for i in range(max(t.get_vocab().values()) + 1)], dtype=object)

    def text(self, ids: bytes) -> str:
        return " ".join(self.piece[np.frombuffer(ids, dtype="<u4")].tolist())


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of every whole text as unsigned 32-bit little-endian binary.

    With decoded, the text that the ids stand for as well, made in the pass that puts the ids together.

    A null text is empty and gets no ids. Repeated rows and null doc_ids are encoded like any other; ids equal those
    of the tokenizer on the whole text without added special tokens.
    """
    spark, path = docs.sparkSession, path or default_path()
    table = word_table(docs, path)
    least = frequent(table, HEAD_KEYS)
    # the most frequent first: small places, which compress well
    head_rows = table.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").select("key", "ids").toArrow()
    head = spark.sparkContext.broadcast(Head(pa.array(head_rows.column(0).combine_chunks(), pa.string())))
    sizes = np.array([len(i) >> 2 for i in head_rows.column(1).to_pylist()], dtype=np.int32)
    head_ids = spark.sparkContext.broadcast((sizes, np.frombuffer(b"".join(head_rows.column(1).to_pylist()), dtype="<u4")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, 2):
            with no_cycle_search():
                words, at, n_words = distinct_words(b.column(2))
                keys, n_keys = keys_in(words)
                place = np.array(head.value.find(keys.dictionary.to_numpy(zero_copy_only=False).tolist()), dtype=np.int32)
            key = keys.indices.to_numpy()
            starts, end = np.cumsum(n_keys) - n_keys, 0
            for part, n in zip(slices(iter([b])), np.split(n_words, range(128, len(n_words), 128))):
                begin, end = end, end + int(n.sum())
                own, ends = rows_of(n_keys, starts, at[begin:end])
                own = key[own]  # every key of these texts in turn
                bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(n)))]  # each text's among them
                here = place[own]
                hole = here < 0
                before = np.concatenate(([0], np.cumsum(~hole)))  # keys of the head table before each
                known = here[~hole]
                rows = [packed(known[i:j]) for i, j in pairwise(before[bounds].tolist())]
                at_hole = (before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds)))[hole]
                offsets = pa.array((bounds - before[bounds]).astype(np.int32))
                places = pa.ListArray.from_arrays(offsets, pa.array(at_hole.astype(np.int32)))
                missing = pa.ListArray.from_arrays(offsets, keys.dictionary.take(pa.array(own[hole])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary()), places, missing], names=["doc_id", "mark", "known", "places", "missing"])

    text = text_column(docs)
    halves = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(first, "doc_id long, mark long, known binary, places array<int>, missing array<string>")
    # both uses read all columns of one exchange, so the pass over the texts runs once
    halves = halves.withColumn("id0", F.coalesce("doc_id", F.lit(0))).repartition("id0", "mark")

    def holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("missing")
            n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b.column("id0").take(pa.array(row)), b.column("mark").take(pa.array(row)), pa.array(at.astype(np.int32)), lists.flatten()], names=["id0", "mark", "at", "key"])

    rare = halves.mapInArrow(holes, "id0 long, mark long, at int, key string")
    found = rare.join(table.filter(F.col("n") < least).select("key", "ids"), "key").groupBy("id0", "mark").agg(F.collect_set(F.struct("at", "ids")).alias("found"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path) if decoded else None
        sizes, flat = head_ids.value
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        for b in slices(batches):
            out = []
            for row, places, got in zip(*(b.column(c).to_pylist() for c in ("known", "places", "found"))):
                at = unpacked(row)
                own, ends = rows_of(sizes, starts, at)
                whole = flat[own].tobytes()
                if got:
                    ids = {x["at"]: x["ids"] for x in got}  # a set: rows that repeat give each place again
                    parts, last = [], 0
                    for i, end in enumerate((np.concatenate(([0], ends))[places] * 4).tolist()):
                        parts += [whole[last:end], ids[i]]
                        last = end
                    whole = b"".join([*parts, whole[last:]])
                out.append(whole)
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array([len(x) >> 2 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())}
            if pieces:
                cols["decoded"] = pa.array(map(pieces.text, out), pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    whole = halves.join(found, ["id0", "mark"], "left")
    return whole.mapInArrow(second, "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with `decoded`, the text of its `ids`, by a lookup of every id in the id-to-piece table."""
    path = path or default_path()
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in slices(batches):
            yield b.append_column("decoded", pa.array(map(pieces.text, b.column("ids").to_pylist()), pa.string()))

    return encoded.mapInArrow(run, schema)


def bpe_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text they decode to."""
    done = encode(docs, path, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

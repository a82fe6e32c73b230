"""Markdown into ordered parent and child chunks.

In stages, each over rows that Spark deals out anew:

1. Documents become blocks. An open fence (``` or ~~~, closed only by its own mark) hides headings, and of each level
   the last heading counts unless a higher one has come since; runs of lines under one heading are sections, runs of
   lines of one kind are blocks.
2. Paragraphs over the limit become sentences, which get vectors by a join, distances by windows and chunks by a fold
   over their sizes, and come back as pieces. The pieces of a paragraph joined are the paragraph, to the character.
3. Blocks and pieces of a section, in order, are packed into chunks by a fold over their sizes.
4. Parents, islands of sections with one top heading, are numbered by windows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evistra.operators.semantic import semantic_chunks
from evistra.sources.shared import kept

TARGET, MOST = 320, 512
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_RULE = re.compile(r"\s*([-*_])\1{2,}\s*$")
_FENCE = re.compile(r"\s*(```|~~~)")
_UNIT = re.compile(r"[一-鿿]|[^\s一-鿿]+")
#: Marks that end a sentence.
TERMINATORS = "。！？；!?;"


def count_tokens(text: str) -> int:
    """Ideographs one by one, and other words."""
    return len(_UNIT.findall(text))


def fence_mark(line: str) -> str:
    """The mark of a line that begins or ends a fence, else empty."""
    m = _FENCE.match(line)
    return m[1] if m else ""


def fences(lines: list[str]) -> list[tuple[str, bool]]:
    """For each line the mark of the fence it belongs to (its own lines included, else empty), and whether it opens one."""

    def step(state: tuple[str, bool, str], line: str) -> tuple[str, bool, str]:
        _, _, inside = state  # the mark that is open before this line
        mark = fence_mark(line)
        if not inside:
            return mark, bool(mark), mark
        return inside, False, "" if mark == inside else inside

    return [(mark, opens) for mark, opens, _ in accumulate(lines, step, initial=("", False, ""))][1:]


def sections(body: str) -> list[tuple[list[str], str]]:
    """(heading path, text) in order. First-level titles never enter a path; empty sections are dropped; headings
    inside code fences are text."""
    lines = body.split("\n")
    found = [None if mark else _HEADING.match(x) for x, (mark, _) in zip(lines, fences(lines))]
    at = list(accumulate(int(m is not None) for m in found))  # the section of each line
    heads = [(len(m[1]), m[2]) for m in found if m]
    paths: list[list[str]] = [[]]
    last: dict[int, str] = {}  # of each level the last heading that no higher or equal one has followed
    for level, title in heads:
        last = {k: t for k, t in last.items() if k < level} | {level: title}
        paths.append([t for k, t in sorted(last.items()) if k > 1])
    texts = {n: "\n".join(x for x, m, _ in part if not m and not _RULE.match(x)).strip() for n, part in groupby(zip(lines, found, at), key=lambda x: x[2])}
    return [(path, texts[n]) for n, path in enumerate(paths) if texts.get(n)]


def blocks(text: str) -> list[tuple[str, str]]:
    """(kind, text): fenced code and tables whole, paragraphs between blank lines."""
    lines = text.split("\n")
    state = fences(lines)
    kinds = ["code" if mark else "" if not x.strip() else "table" if x.lstrip().startswith("|") else "text" for x, (mark, _) in zip(lines, state)]
    after_end = [i > 0 and bool(state[i - 1][0]) and (not state[i][0] or state[i][1]) for i in range(len(lines))]
    number = accumulate(int(i == 0 or kinds[i] != kinds[i - 1] or state[i][1] or after_end[i]) for i in range(len(lines)))
    runs = groupby(zip(number, kinds, lines), key=lambda x: x[:2])
    return [(kind, "\n".join(x[2] for x in run).strip()) for (_, kind), run in runs if kind]


def sentences(text: str, terminators: str = TERMINATORS) -> list[str]:
    """The text's sentences, each with the white space after it: joined they are the text.

    One ends at a mark and at the end of a line.
    """
    return re.findall(rf"[^\n]*?(?:[{terminators}][^\S\n]*(?:\n\s*)?|\n\s*|$)", text)[:-1] if text else []


def hard_split(text: str, most: int = MOST) -> list[str]:
    """The text cut at the longest beginnings of at most `most` tokens; joined they are the text."""
    starts = [m.start() for m in _UNIT.finditer(text)][::most]
    return [text[i:j] for i, j in zip([0, *starts[1:]], [*starts[1:], len(text)])] if text else []


class Place(NamedTuple):
    """Where the fold over blocks stands: the chunk's number, its tokens, whether it takes nothing more."""

    chunk: int = 0
    size: int = 0
    closed: bool = False

    def after(self, n: int, limit: int, alone: bool = False, full: float = float("inf")) -> Place:
        """The place of a block of n tokens: in the same chunk unless that is closed or would pass the limit; a chunk
        is closed by a block that stands alone, and once it holds `full` tokens."""
        fresh = self.closed or (self.size > 0 and (alone or self.size + n > limit))
        size = n if fresh else self.size + n
        return Place(self.chunk + fresh, size, alone or size >= full)

    def of(self, kind: str, n: int, alone: bool) -> Place:
        """The place of the next block: text fits up to TARGET, whole tables and code up to MOST and close a chunk from
        TARGET on; a piece of a long paragraph is a chunk of its own."""
        return self.after(n, TARGET, alone) if kind == "text" else self.after(n, MOST, False, TARGET)


def merged(chunk: list[tuple[str, str]]) -> tuple[str, str]:
    """(kind, text) of a chunk's blocks: of the kind of its first table or code, else text."""
    return next((kind for kind, _ in chunk if kind != "text"), "text"), "\n\n".join(text for _, text in chunk)


_BLOCKS = "doc_id string, section int, block int, path array<string>, kind string, n_tokens int, text string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields)], names=[name for name, _ in fields])


def document_blocks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, body) into the blocks of their sections, in order: doc_id, section, block, path, kind, n_tokens, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(doc, n, i, path, kind, count_tokens(t), t) for n, (path, text) in enumerate(sections(body or "")) for i, (kind, t) in enumerate(blocks(text)) if t]
                yield _batch(rows, _BLOCKS)

    return docs.select(F.col("doc_id").cast("string"), "body").mapInArrow(run, _BLOCKS)


_SENTENCES = "paragraph string, pos int, n_tokens int, text string"
_PIECES = "paragraph string, piece int, part int, n_tokens int, text string"


def long_pieces(long: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, terminators: str = TERMINATORS) -> DataFrame:
    """Paragraphs (paragraph string, text) over the limit into pieces that end where the topic changes.

    `embed` gives sentences (paragraph, pos, n_tokens, text) a column vec of unit vectors; where it is null, or without
    `embed`, only the sizes count. Rows: paragraph, piece, part, n_tokens, text; joined in order they are the text.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for paragraph, text in zip(*(c.to_pylist() for c in b.columns)):
                yield _batch([(paragraph, i, count_tokens(s), s) for i, s in enumerate(sentences(text, terminators))], _SENTENCES)

    said = kept(long.select("paragraph", "text").mapInArrow(split, _SENTENCES), "sentences")
    with_vec = said.withColumn("vec", F.lit(None).cast("array<double>")) if embed is None else embed(said)
    chunks = semantic_chunks(with_vec.select("paragraph", "pos", "n_tokens", "vec"), TARGET, MOST)
    # a piece holds MOST tokens at most, or one sentence
    line = F.array_sort(F.collect_list(F.struct("pos", "text")))
    pieces = said.join(chunks, ["paragraph", "pos"]).groupBy("paragraph", "chunk").agg(F.array_join(F.transform(line, lambda x: x["text"]), "").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for paragraph, piece, text in zip(*(c.to_pylist() for c in b.columns)):
                yield _batch([(paragraph, piece, i, count_tokens(t), t) for i, t in enumerate(hard_split(text))], _PIECES)

    return pieces.mapInArrow(cut, _PIECES)


_CHUNKS = "doc_id string, section int, piece int, path array<string>, kind string, body string"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, section, path, kind, n_tokens, text, alone in order, into chunks; holds one chunk at a time."""
    at, section, held = Place(), None, []

    def done() -> tuple:
        doc, n, path = section
        return (doc, n, at.chunk, path, *merged(held))

    for b in batches:
        out = []
        for doc, n, path, kind, size, text, alone in zip(*(c.to_pylist() for c in b.columns)):
            same = section is not None and section[:2] == (doc, n)
            after = (at if same else Place()).of(kind, size, alone)
            if held and (not same or after.chunk != at.chunk):
                out.append(done())
                held = []
            at, section = after, (doc, n, path)
            held.append((kind, text))
        yield _batch(out, _CHUNKS)
    if held:
        yield _batch([done()], _CHUNKS)


def chunk_documents(docs: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, terminators: str = TERMINATORS) -> DataFrame:
    """docs (doc_id string, body) into doc_id, parent_seq, chunk_index, parent_id, chunk_id, section_path, kind, body.

    Parents are runs of sections with the same top heading; sections before any heading are parents of their own.
    `embed` and `terminators` are those of long_pieces(). A null or empty body has no chunks; doc_ids differ.
    """
    found = kept(document_blocks(docs), "blocks")
    over = (F.col("kind") == "text") & (F.col("n_tokens") > MOST)
    long = found.filter(over).withColumn("paragraph", F.concat_ws("\0", F.coalesce("doc_id", F.lit("\0")), "section", "block"))
    pieces = long_pieces(long, embed, terminators).join(long.select("paragraph", "doc_id", "section", "block", "path", "kind"), "paragraph")
    cols = ("doc_id", "section", "block", "piece", "part", "path", "kind", "n_tokens", "text", "alone")
    rows = found.filter(~over).withColumns({"piece": F.lit(0), "part": F.lit(0), "alone": F.lit(False)}).select(*cols).union(pieces.withColumn("alone", F.lit(True)).select(*cols))
    dealt = rows.repartition("doc_id", "section").sortWithinPartitions("doc_id", "section", "block", "piece", "part")
    chunks = dealt.select("doc_id", "section", "path", "kind", "n_tokens", "text", "alone").mapInArrow(_packed, _CHUNKS)
    order = Window.partitionBy("doc_id").orderBy("section", "piece")
    top = F.get("path", F.lit(0))
    same = (F.lag("section").over(order) == F.col("section")) | (top == F.lag(top).over(order))
    p = chunks.withColumn("parent_seq", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order) - 1)
    p = p.withColumn("chunk_index", F.row_number().over(Window.partitionBy("doc_id", "parent_seq").orderBy("section", "piece")) - 1)
    p = p.withColumn("parent_id", F.format_string("%s#%03d", "doc_id", "parent_seq"))
    return p.select("doc_id", "parent_seq", "chunk_index", "parent_id", F.format_string("%s:%02d", "parent_id", "chunk_index").alias("chunk_id"), F.array_join("path", " > ").alias("section_path"), "kind", "body")

"""Table functions for SQL: sections and sentences of a text by LATERAL, blocks of lines by PARTITION BY."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from evistra.operators import chunking


@udtf(returnType="section int, path array<string>, text string")
class Sections:
    """A Markdown text's sections in order, with their heading paths; none of a null text."""

    def eval(self, body: str) -> Iterator[tuple]:
        for n, (path, text) in enumerate(chunking.sections(body or "")):
            yield n, path, text


@udtf(returnType="pos int, sentence string")
class Sentences:
    """A text's sentences in order, each with the white space after it; `marks` end one besides the end of a line."""

    def eval(self, text: str, marks: str) -> Iterator[tuple]:
        yield from enumerate(chunking.sentences(text or "", marks or chunking.TERMINATORS))


@udtf(returnType="doc_id long, block int, kind string, first_line int, n_lines int")
class Blocks:
    """The blocks of a document's lines: called on a table (doc_id, line, text) PARTITION BY doc_id ORDER BY line.

    Lines come one by one; what is kept is the open fence and where the present block began. Fenced lines are code, lines
    that begin with a bar a table, others text; blank lines outside of fences part blocks and are in none.
    """

    def __init__(self):
        self.fence, self.kind, self.first, self.n, self.block, self.doc = "", "", 0, 0, 0, None

    def _done(self) -> Iterator[tuple]:
        if self.kind:
            yield self.doc, self.block, self.kind, self.first, self.n
            self.block += 1
        self.kind, self.n = "", 0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.doc, text = row["doc_id"], row["text"] or ""
        mark = chunking.fence_mark(text)
        opens = bool(mark) and not self.fence
        kind = "code" if self.fence or opens else "" if not text.strip() else "table" if text.lstrip().startswith("|") else "text"
        if kind != self.kind or opens:
            yield from self._done()
            self.kind, self.first = kind, row["line"]
        self.n += 1
        closes = bool(self.fence) and mark == self.fence
        self.fence = mark if opens else "" if closes else self.fence
        if closes:
            yield from self._done()

    def terminate(self) -> Iterator[tuple]:
        yield from self._done()


def register(spark: SparkSession) -> None:
    """Name the functions for SQL: text_sections, text_sentences, line_blocks."""
    for name, function in (("text_sections", Sections), ("text_sentences", Sentences), ("line_blocks", Blocks)):
        spark.udtf.register(name, function)

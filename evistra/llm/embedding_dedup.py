"""Near-duplicate vectors by a dual traversal of cover trees.

Equal vectors of a label become one class with a count. The classes of a large label are dealt to blocks of bounded
size; a task holds one block and streams half of the label's other blocks past it, so that every pair of classes meets
in exactly one task and a class is sent to half as many tasks as there are blocks. A round
takes one block past each, and its shuffle is dropped before the next, so that the disk holds three copies of the
classes, however many blocks there are. In a task a cover tree (nested levels, radii halving) is built over the block and over each run of
the stream, and pairs of nodes are visited together: dropped when their covering radii prove them apart, taken whole when
the radii prove them linked, opened otherwise. Leaves are compared by an upper bound first: the product of half of the
rotated components in single precision, plus what the rest could add at most (Cauchy and Schwarz).
Distances come from products and are uncertain by about the root of the precision near zero, so radii and bound only
decide beyond a margin far above that, and what lies within it is decided by the product in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from evistra.llm._common import components, drop_shuffles, materialize, merge_labels, runs

THRESHOLD = 0.93
#: Classes of a label from which it is divided, into up to SPREAD blocks; classes of a block at most, for vectors of up to
#: BLOCK_BYTES bytes (longer ones: fewer); classes of the stream compared at a time; points of a leaf, children of a node.
CELL, SPREAD, BLOCK, BLOCK_BYTES, STEP, LEAF, CHILDREN = 2048, 3, 1 << 18, 256, 8192, 32, 64
#: Blocks that pass a block in a round; rows and columns of a tile; linked pairs that a task holds at a time.
PASSING, TILE, HELD = 1, (256, 1024), 1 << 20
#: Margin of distances sqrt(2 - 2 cos): an error of 1e-16 in a product near 1 makes one of 1.5e-8 in the distance; the
#: same and that of products in single precision; components beyond which no rotation is made.
_SLACK, _SLACK_SINGLE, _MARGIN_SINGLE, _ROTATED = 1e-6, 2e-2, 1e-4, 2048


@dataclass
class Node:
    """Points `at` (indices) within `radius` of the centre, the first of them."""

    at: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, at: np.ndarray | None = None, level: int = 1) -> Node | None:
    """Cover tree over the unit vectors x: a child's points lie within half its parent's level of its centre.

    A node becomes a leaf with few points, or where covering it would take as many children as a scan (points
    without clusters in high dimensions).
    """
    at = np.arange(len(x)) if at is None else at
    if not len(at):
        return None
    d = np.sqrt(np.maximum(0.0, 2 - 2 * (x[at] @ x[at[0]])))
    node = Node(at, float(d.max()))
    if len(at) <= LEAF or node.radius < _SLACK:
        return node
    while 2.0**level >= 2 * node.radius:
        level -= 1
    rest, parts = at, []
    while len(rest):
        if len(parts) >= min(CHILDREN, max(2, len(at) // 4)):
            return node
        near = np.sqrt(np.maximum(0.0, 2 - 2 * (x[rest] @ x[rest[0]]))) <= 2.0 ** (level - 1)
        near[0] = True
        parts.append(rest[near])
        rest = rest[~near]
    if len(parts) > 1:
        node.children = [cover_tree(x, p, level - 1) for p in parts]
    return node


class Pairs:
    """Pairs of linked points, which join the classes in labels HELD at a time."""

    def __init__(self, labels: np.ndarray):
        self.labels, self.held, self.size = labels, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size > HELD:
            self.flush()

    def flush(self) -> None:
        if self.held:
            merge_labels(self.labels, *(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.size = [], 0


@dataclass
class Bounds:
    """For points i and j, head[i] @ head[j] is no less than their product; unit gives exact unit vectors of points."""

    head: np.ndarray
    unit: Callable[[np.ndarray], np.ndarray]

    def hits(self, rows: np.ndarray, columns: np.ndarray, at: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in rows and columns of those of the pairs `at` (of their grid) that have a product of threshold or more."""
        p, q = np.divmod(at, len(columns))
        some, others = (np.flatnonzero(np.bincount(z)) for z in (p, q))
        i, j = np.searchsorted(some, p), np.searchsorted(others, q)
        x, y = self.unit(rows[some]), self.unit(columns[others])
        if 8 * len(at) >= len(some) * len(others):
            sure = (x @ y.T)[i, j] >= threshold
        else:
            sure = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        return p[sure], q[sure]


def linked(
    x: np.ndarray, a: Node | None, b: Node | None, weight: np.ndarray, count: np.ndarray, labels: np.ndarray, threshold: float,
    bounds: Bounds | None = None, slack: float = _SLACK,
) -> None:
    """Add each point's linked weight to count, and join the classes of linked points in labels, for pairs a x b.

    With bounds, x may be rough, by what slack says at most.
    """
    if a is None or b is None:
        return
    bounds = bounds or Bounds(x, lambda at: x[at])
    reach = float(np.sqrt(2 - 2 * threshold))
    todo, pairs, low = [(a, b)], Pairs(labels), np.float32(threshold - _MARGIN_SINGLE)
    while todo:
        a, b = todo.pop()
        same = a is b
        d = 0.0 if same else float(np.sqrt(max(0.0, 2 - 2 * float(x[a.at[0]] @ x[b.at[0]]))))
        if d - a.radius - b.radius > reach + slack:
            continue
        if d + a.radius + b.radius <= reach - slack:
            if same:
                count[a.at] += weight[a.at].sum() - weight[a.at]
                pairs.add(a.at[1:], np.full(len(a.at) - 1, a.at[0]))
            else:
                count[a.at] += weight[b.at].sum()
                count[b.at] += weight[a.at].sum()
                both = np.concatenate((a.at[1:], b.at))
                pairs.add(both, np.full(len(both), a.at[0]))
            continue
        if same and a.children:
            todo += [(p, q) for i, p in enumerate(a.children) for q in a.children[i:]]
        elif not same and (a.children or b.children):
            if a.children and (not b.children or a.radius >= b.radius):
                todo += [(p, b) for p in a.children]
            else:
                todo += [(a, q) for q in b.children]
        else:
            # by the bound, then by the product
            for k in range(0, len(b.at), TILE[1]):
                columns = b.at[k : k + TILE[1]]
                right = bounds.head[columns].T
                for i in range(0, len(a.at), TILE[0]):
                    rows = a.at[i : i + TILE[0]]
                    if same and i >= k + len(columns):
                        break
                    at = np.flatnonzero(bounds.head[rows] @ right >= low)
                    if 8 * len(at) >= len(rows) * len(columns):
                        hit = bounds.unit(rows) @ bounds.unit(columns).T >= threshold
                        if same:
                            hit &= np.arange(i, i + len(rows))[:, None] < np.arange(k, k + len(columns))
                        count[rows] += hit @ weight[columns]
                        count[columns] += hit.T @ weight[rows]
                        # each with its first one, then what is still apart
                        some, others = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                        pairs.add(np.concatenate((rows[some], rows[hit.argmax(axis=0)[others]])), np.concatenate((columns[hit.argmax(axis=1)[some]], columns[others])))
                        pairs.flush()
                        p, q = np.nonzero(hit & (labels[rows][:, None] != labels[columns]))
                        pairs.add(rows[p], columns[q])
                    elif len(at):
                        p, q = bounds.hits(rows, columns, at, threshold)
                        if same:
                            ahead = i + p < k + q
                            p, q = p[ahead], q[ahead]
                        p, q = rows[p], columns[q]
                        # a point may be in many of the pairs
                        np.add.at(count, p, weight[q])
                        np.add.at(count, q, weight[p])
                        pairs.add(p, q)
    pairs.flush()


def unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per label and different vector: label, dim, h1, h2, embedding, id (smallest vec_id), times."""
    return rows.groupBy("label", "dim", "h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"))


def in_blocks(classes: DataFrame) -> DataFrame:
    """classes with parts (blocks of their label) and own, the block they are in."""
    width = 8 if classes.schema["embedding"].dataType.elementType == DoubleType() else 4
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK * BLOCK_BYTES) / F.greatest(F.lit(BLOCK_BYTES), width * F.col("dim"))))
    big = classes.groupBy("label", "dim").count().filter(F.col("count") > F.least(F.lit(CELL), most))
    big = big.select("label", "dim", F.greatest(F.ceil(F.col("count") / most), F.least(F.lit(SPREAD), F.ceil(F.col("count") / CELL))).cast("int").alias("parts"))
    # a label of it has CELL classes at least: a join would send all vectors once more, a label's to one task
    out = classes.join(F.broadcast(big), ["label", "dim"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return out.withColumn("own", F.pmod(F.xxhash64("h1", "h2", F.lit("block")), F.col("parts")).cast("int"))


def passing(blocks: DataFrame, offsets: range) -> DataFrame:
    """Rows of a round: every block at home, and as a guest of the blocks that lie the offsets before it.

    Blocks stand in a ring; those at an offset of up to half of it meet there, those right across at the first of the two.
    """
    o, n = F.col("offset"), F.col("parts")
    meets = (2 * o < n) | ((2 * o == n) & (F.col("own") >= o))
    sent = blocks.select("*", F.explode(F.array(F.lit(0), *(F.lit(k) for k in offsets))).alias("offset"))
    # a later round needs none of the labels whose blocks have all met
    sent = sent.filter((o == 0) & (2 * offsets[0] <= n) | (o > 0) & meets) if offsets[0] > 1 else sent.filter((o == 0) | meets)
    return sent.select("label", "dim", F.pmod(F.col("own") - o, n).cast("int").alias("block"), (o > 0).alias("guest"), (n > 1).alias("visited"), "embedding", "id", "times")


class Block:
    """A block's classes, and room for those of the stream behind them."""

    def __init__(self, held: list[pa.RecordBatch], room: int):
        n, first = sum(g.num_rows for g in held), vectors(held[0].column("embedding"))
        dim = first.shape[1]
        self.n, self.half = n, (dim + 1) // 2
        self.turn = rotation(dim)
        self.raw = np.empty((n + room, dim), dtype=first.dtype)
        self.x = np.empty((n + room, dim), dtype=np.float32)
        self.head = np.empty((n + room, self.half + 1), dtype=np.float32)
        self.ids, self.weight = (np.empty(n + room, dtype=np.int64) for _ in range(2))
        self.count, self.labels = np.zeros(n + room, dtype=np.int64), np.arange(n + room)
        while held:  # lets go of what has been copied
            n -= held[-1].num_rows
            self.put(n, held.pop())
        self.bounds = Bounds(self.head, lambda at: unit(self.raw[at]))
        self.tree = cover_tree(self.x, np.arange(self.n))

    def put(self, at: int, g: pa.RecordBatch) -> None:
        for k in range(0, g.num_rows, STEP):
            self._put(at + k, g.slice(k, STEP))

    def _put(self, at: int, g: pa.RecordBatch) -> None:
        raw, to = vectors(g.column("embedding")), slice(at, at + g.num_rows)
        y = unit(raw) @ self.turn if self.turn is not None else unit(raw)
        self.raw[to], self.x[to], self.ids[to], self.weight[to] = raw, y, g.column("id").to_numpy(), g.column("times").to_numpy()
        self.head[to, :-1] = y[:, : self.half]
        self.head[to, -1] = np.sqrt(np.maximum(0.0, 1 - (y[:, : self.half] ** 2).sum(axis=1)))

    def among(self, threshold: float) -> None:
        linked(self.x, self.tree, self.tree, self.weight, self.count, self.labels, threshold, self.bounds, _SLACK_SINGLE)

    def meet(self, g: pa.RecordBatch, threshold: float) -> Iterator[pa.RecordBatch]:
        """What the stream's classes link with here."""
        for k in range(0, g.num_rows, STEP):
            part = g.slice(k, STEP)
            at = np.arange(self.n, self.n + part.num_rows)
            self.put(self.n, part)
            self.count[at], self.labels[at] = 0, at
            linked(self.x, cover_tree(self.x, at), self.tree, self.weight, self.count, self.labels, threshold, self.bounds, _SLACK_SINGLE)
            yield from self.found(at)

    def found(self, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = at[self.count[at] > 0]
        if len(at):
            ids, other = self.ids[at], self.ids[self.labels[at]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(self.count[at]), pa.array(other, mask=other == ids)], names=["id", "links", "other"])


def rotation(dim: int) -> np.ndarray | None:
    """An orthogonal matrix, so that no components weigh more than others by their place."""
    if dim not in _TURNS:
        _TURNS.clear()
        _TURNS[dim] = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0] if dim <= _ROTATED else None
    return _TURNS[dim]


_TURNS: dict[int, np.ndarray | None] = {}


def round_links(sent: DataFrame, threshold: float, first: bool) -> DataFrame:
    """(id, links, other) of the pairs that meet in a round; the first one has the pairs inside blocks, too."""
    where = ["label", "dim", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, block = None, [], None
        for key, g in runs(batches, [*where, "guest"]):
            if key[:-1] != last:
                yield from done(held, block)
                last, held, block = key[:-1], [], None
            if not key[-1]:
                held.append(g)
                continue
            if block is None:
                if not held:  # a block of a few classes may be empty
                    continue
                block = opened(held)
            yield from block.meet(g, threshold)
        yield from done(held, block)

    def opened(held: list[pa.RecordBatch]) -> Block:
        block = Block(held, STEP if held[0].column("visited")[0].as_py() else 0)
        if first:
            block.among(threshold)
        return block

    def done(held: list[pa.RecordBatch], block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is None and first and sum(g.num_rows for g in held) > 1:
            block = opened(held)
        if block is not None:
            yield from block.found(np.arange(block.n))

    return sent.repartition(*where).sortWithinPartitions(*where, "guest").mapInArrow(run, "id long, links long, other long")


def class_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, links, other): rows that add up to each class's linked vectors, and edges (other is null or a linked id)."""
    blocks = in_blocks(classes)
    parts = blocks.agg(F.max("parts")).first()[0] or 1
    found = None
    for k in range(1, max(2, parts // 2 + 1), PASSING):
        drop_shuffles(classes.sparkSession)
        links = materialize(round_links(passing(blocks, range(k, k + PASSING)), threshold, k == 1), "links")
        found = links if found is None else found.union(links)
    return found


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows with a null label or vec_id, and vectors that are null, empty, zero or hold null or non-finite components,
    link with nothing; neither do vectors of different lengths. Equal vectors link with one another. Rows that share
    a vec_id are separate vectors of one component. Components of any numeric type are taken as they are, labels are
    equal where their values are. An empty table gives no rows.
    """
    kind = embeddings.schema["embedding"].dataType
    own = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    e = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(own), F.col("label").cast("string"))
    big = F.lit(float("inf"))
    sound = (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
        & F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big)), F.lit(False))
        & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    )
    e = e.withColumn("sound", F.coalesce(sound, F.lit(False)))
    e = e.withColumn("dim", F.size("embedding")).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    good = e.filter("sound")
    key = ["label", "dim", "h1", "h2"]
    classes = materialize(classes_of(good), "classes")
    found = class_links(classes, threshold)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    comp = components(edges)
    done = (
        classes.drop("embedding").join(counts, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
        .select(*key, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked_rows = good.select("vec_id", *key).join(done, key).select("vec_id", "n_links", "component_id")
    alone = e.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

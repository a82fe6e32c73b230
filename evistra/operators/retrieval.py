"""Batch retrieval: dated hybrid search, rank fusion, quota merge, re-ranking, assembly. All queries are one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistra.functions.numbers import fixed
from evistra.sources.shared import kept

RRF_K, CAP, MIN_SCORE, TOP_K = 20, 20, 0.30, 4
DEFAULT_PRIOR = 0.9
K1, B = 1.2, 0.75
#: Intents that put the law first, and how many rows each layer gives then and otherwise.
LAW_INTENTS, LAYERS = ("validity", "dispute"), ("platform", "law")
LAW_FIRST_K, PLAIN_K = {"platform": 12, "law": 12}, {"platform": 18, "law": 5}
MOST_K = max(*LAW_FIRST_K.values(), *PLAIN_K.values())
#: Queries broadcast at once; rows that meet them at once in one task (2 million scores); rows of the queries' terms that
#: are broadcast at most.
QUERY_BLOCK, ROW_SLICE, TERM_ROWS = 16384, 128, 500_000
TOKEN = r"[\p{L}\p{N}]+"


def valid_on(day: str) -> Column:
    """In force on a day: from effective_date up to, not including, expire_date."""
    return (F.col("effective_date") <= day) & (F.col("expire_date") > day)


def top_k(scored: DataFrame, keys: list[str], k: Column | int, ties: str, most: int | None = None) -> DataFrame:
    """The best k of each key by score, ties by the smaller id; rank added. Filters belong below this.

    Where k is a column, `most` is its greatest value: a limit the planner knows lets every task pass on that many rows
    of a key only, before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), ties))
    ranked = scored.withColumn("rank", rank)
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).filter(F.col("rank") <= k)


def routes(plans: DataFrame) -> DataFrame:
    """plans (query_id, needs_law, sub_queries: array of struct id, intent, text, vec) into a row for each sub-query:
    query_id, sub_id, text, qvec, k_platform, k_law, law_weight, n_routes.

    The law comes first where the plan or the sub-query's intent asks for it: both layers then give as many rows.
    """
    sub = plans.select("query_id", "needs_law", F.size("sub_queries").alias("n_routes"), F.explode("sub_queries").alias("s"))
    first = F.col("needs_law") | F.col("s.intent").isin(*LAW_INTENTS)
    k = lambda layer: F.when(first, LAW_FIRST_K[layer]).otherwise(PLAIN_K[layer]).alias(f"k_{layer}")
    return sub.select("query_id", F.col("s.id").alias("sub_id"), F.col("s.text").alias("text"), F.col("s.vec").alias("qvec"), k("platform"), k("law"), F.when(first, 1.0).otherwise(0.5).alias("law_weight"), "n_routes")


def plans_of(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """queries (query_id, text, vec) with their plan: as cached (query_id, needs_law, sub_queries); else passed through as
    one sub-query of no special intent. `rewritten` tells which."""
    alone = F.array(F.struct(F.lit("q1").alias("id"), F.lit("other").alias("intent"), "text", "vec"))
    p = queries.join(cache.select("query_id", "needs_law", "sub_queries"), "query_id", "left")
    known = F.coalesce(F.size("sub_queries") > 0, F.lit(False))
    return p.select("query_id", F.when(known, F.col("needs_law")).otherwise(False).alias("needs_law"), F.when(known, F.col("sub_queries")).otherwise(alone).alias("sub_queries"), known.alias("rewritten"))


class Best:
    """The `most` best ids of each query, ties by the smaller id, of those whose score reaches the query's floor."""

    def __init__(self, floor: np.ndarray, most: int) -> None:
        self.floor, self.most, self.held, self.rows = floor.copy(), most, 0, []

    def add(self, score: np.ndarray, ids: np.ndarray, own: np.ndarray | bool = True) -> None:
        """ids by queries: their scores, and which of them count."""
        i, q = np.nonzero((score >= self.floor) & own)
        self.rows.append((q, ids[i], score[i, q]))
        self.held += len(q)
        if self.held > max(500_000, 2 * self.most * len(self.floor)):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """(query, id, score) of the best, in order."""
        q, ids, score = (np.concatenate(c) for c in zip(*self.rows))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        own, last = place < self.most, place == self.most - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        self.rows = [(q[own], ids[own], score[own])]
        self.held = int(own.sum())
        return self.rows[0]

    def batch(self, keys: np.ndarray, group: str, names: list[str]) -> pa.RecordBatch:
        """The best as rows of key, group, id and score."""
        q, ids, score = self.cut()
        return pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array([group], pa.string()).take(pa.array(np.zeros(len(q), np.int64))), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=names)


def dense_topk(subs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, sub_id, layer, chunk_id, score, rank): of each layer the k_<layer> chunks nearest to each sub-query.

    Exact: the sub-queries, a stated set, are held against all chunks (chunk_id, layer, vec). Up to QUERY_BLOCK are
    broadcast; more take turns, each reading the chunks anew, which aren't shuffled. A task holds ROW_SLICE chunks by
    the sub-queries at once and passes on its best of each sub-query and layer.
    """
    sc, step = chunks.sparkSession.sparkContext, ROW_SLICE
    q = kept(subs.select("query_id", "sub_id", "qvec", "k_platform", "k_law").filter("qvec is not null").withColumn("_q", F.monotonically_increasing_id()), "dense-queries")
    n, kinds = q.count(), "_q long, layer string, chunk_id long, score double"
    turns, c = max(1, -(-n // QUERY_BLOCK)), chunks.select("chunk_id", "layer", "vec")
    c = c if turns == 1 else kept(c, "dense-chunks")

    def nearest(block: DataFrame) -> DataFrame:
        own = block.select("_q", "qvec").toArrow()
        shared = sc.broadcast((own.column("_q").to_numpy(), np.array(own.column("qvec").to_pylist(), dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (keys, vecs), best = shared.value, {layer: Best(np.full(len(shared.value[0]), -np.inf), MOST_K) for layer in LAYERS}
            for b in batches if len(keys) else ():
                known = pc.fill_null(pc.equal(pc.list_value_length(b.column("vec")), vecs.shape[1]), False)
                for layer in LAYERS:
                    rows = b.filter(pc.and_(known, pc.fill_null(pc.equal(b.column("layer"), layer), False)))
                    ids, x = rows.column("chunk_id").to_numpy(), pc.list_flatten(rows.column("vec")).to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else None
                    for at in range(0, rows.num_rows, step):
                        best[layer].add(np.round(x[at : at + step].astype(np.float64) @ vecs.T, 6), ids[at : at + step])
            yield from (own.batch(keys, layer, ["_q", "layer", "chunk_id", "score"]) for layer, own in best.items() if own.rows)

        return c.mapInArrow(run, kinds)

    turn = F.pmod(F.xxhash64("_q"), F.lit(turns))
    near = nearest(q.filter(turn == 0))
    for i in range(1, turns):
        near = near.unionByName(nearest(q.filter(turn == i)))
    asked = q.select("_q", "query_id", "sub_id", "k_platform", "k_law")
    k = F.when(F.col("layer") == "law", F.col("k_law")).otherwise(F.col("k_platform"))
    best = top_k(near, ["_q", "layer"], MOST_K, "chunk_id").join(F.broadcast(asked) if n <= TERM_ROWS else asked, "_q").filter(F.col("rank") <= k)
    return best.select("query_id", "sub_id", "layer", "chunk_id", "score", "rank")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bm25_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length in tokens."""
    return docs.select(F.size(tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def bm25_scores(queries: DataFrame, docs: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*keys, doc_id, score) of documents sharing a term with a query (keys, text; a stated set).

    Statistics are the whole collection's. Terms of documents are kept only where a query has them and counted once; up
    to TERM_ROWS of the queries' terms go to the documents, so that no term's documents are gathered; more are joined.
    """
    terms = kept(queries.select(*keys, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")), "bm25-terms")
    wanted = terms.select("term").distinct()
    few = terms.count() <= TERM_ROWS
    small = lambda df: F.broadcast(df) if few else df
    d = docs.select("doc_id", tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    tf = d.select("doc_id", "dl", F.explode("t").alias("term")).join(small(wanted), "term").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = kept(tf, "bm25-counts")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    post = tf.join(small(terms.join(df, "term")), "term").crossJoin(F.broadcast(bm25_stats(docs)))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return post.withColumn("part", part).groupBy(*keys, "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def _order() -> Column:
    """How a hit is ordered: sub-query, layer, path, rank, each in the order in which they are searched."""
    return F.struct("sub_id", F.when(F.col("layer") == "platform", 0).otherwise(1).alias("l"), F.when(F.col("path") == "dense", 0).otherwise(1).alias("p"), "rank")


def _tag(h: Column) -> Column:
    layer, path = F.when(h["l"] == 0, "platform").otherwise("law"), F.when(h["p"] == 0, "dense").otherwise("bm25")
    return F.concat(h["sub_id"], F.lit("/"), layer, F.lit("/"), path, F.lit("#"), h["rank"].cast("string"))


def fuse(ranked: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, sub_id, layer, path, chunk_id, score, rank): rrf, hits with provenance in order,
    sub-queries that found the row, and the score with which it was first seen. A row's parts, one a ranked list, are
    added in the order of its hits, so that its rrf doesn't depend on how tasks are dealt."""
    found = ranked.groupBy("query_id", "chunk_id").agg(
        F.array_sort(F.collect_list(_order())).alias("hits"), F.count_distinct("sub_id").alias("n_subs"), F.min(_order()).alias("first_seen"), F.min_by("score", _order()).alias("first_score")
    )
    rrf = F.aggregate("hits", F.lit(0.0), lambda total, h: total + 1.0 / (RRF_K + h["rank"]))
    return found.select("query_id", "chunk_id", rrf.alias("rrf"), F.transform("hits", _tag).alias("hits"), "n_subs", "first_seen", "first_score", F.col("hits").alias("found"))


def candidates(fused: DataFrame, cap: int = CAP) -> DataFrame:
    """At most cap of a query's fused rows; those of exactly one sub-query get a small bonus."""
    bonus = F.col("rrf") + F.when(F.col("n_subs") == 1, 0.02).otherwise(0.0)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(bonus, 9)), F.desc(F.round("rrf", 9)), "first_seen", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def routed_candidates(fused: DataFrame, plans: DataFrame, cap: int = CAP) -> DataFrame:
    """A query's fused rows, at most cap: each sub-query that found any, in turn, gives up to cap // n rows not yet taken, by
    its own fusion, n being the plan's sub-queries (plans: query_id, n_routes); the others follow in the order of
    candidates(). `turn` is the sub-query that gave the row.

    No more than cap rows of a sub-query, and of all of them, can be taken, so the turns are a fold over short lists.
    """
    hit = fused.select("query_id", "chunk_id", F.explode("found").alias("h"))
    own = hit.groupBy("query_id", F.col("h.sub_id").alias("sub_id"), "chunk_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    own = own.withColumn("own", F.round(F.aggregate("hs", F.lit(0.0), lambda total, h: total + 1.0 / (RRF_K + h["rank"])), 9))
    place = F.row_number().over(Window.partitionBy("query_id", "sub_id").orderBy(F.desc("own"), F.get("hs", F.lit(0)), "chunk_id"))
    best = own.withColumn("place", place).filter(F.col("place") <= cap)
    in_order = lambda x, c: F.transform(F.array_sort(F.collect_list(x)), lambda r: r[c])
    lists = best.groupBy("query_id", "sub_id").agg(in_order(F.struct("place", "chunk_id"), "chunk_id").alias("ids"))
    lists = lists.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("sub_id", "ids"))).alias("lists")).join(plans.select("query_id", "n_routes").distinct(), "query_id")
    quota = F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("n_routes"))).cast("int")
    taken = F.array().cast("array<struct<chunk_id:bigint,turn:string>>")
    given = lambda done, x: F.slice(F.array_except(x["ids"], F.transform(done, lambda t: t["chunk_id"])), 1, F.col("quota"))
    turns = F.aggregate("lists", taken, lambda done, x: F.concat(done, F.transform(given(done, x), lambda i: F.struct(i.alias("chunk_id"), x["sub_id"].alias("turn")))))
    turns = lists.withColumn("quota", quota).select("query_id", "n_routes", F.posexplode(turns).alias("at", "t")).select("query_id", "n_routes", "at", "t.chunk_id", "t.turn")
    rest = candidates(fused, cap).select("query_id", "chunk_id", F.col("rank").alias("g"))
    both = rest.join(turns.drop("n_routes"), ["query_id", "chunk_id"], "full").join(lists.select("query_id", "n_routes"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("at"), "g")
    chosen = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    return chosen.join(fused.select("query_id", "chunk_id", "rrf", "hits", "n_subs"), ["query_id", "chunk_id"]).select("query_id", "chunk_id", "rrf", "hits", "n_subs", "rank", "turn", "n_routes")


def rerank(cands: DataFrame, priors: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """cands (rrf, layer, doc, law_weight, hits) scored 0.8 relevance + 0.2 prior; those below min_score go first.

    The prior is the layer's (law_weight for the law, else 1) times the document's (priors: doc, doc_prior; a list of
    documents that a person wrote, so it is broadcast), DEFAULT_PRIOR where it has none.
    """
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    c = cands.join(F.broadcast(priors), "doc", "left").withColumn("relevance", F.col("rrf") / F.when(top > 0, top).otherwise(1.0))
    c = c.withColumn("prior", F.when(F.col("layer") == "platform", 1.0).otherwise(F.col("law_weight")) * F.coalesce("doc_prior", F.lit(DEFAULT_PRIOR)))
    raw = 0.8 * F.col("relevance") + 0.2 * F.col("prior")
    scored = c.withColumn("why", why(F.col("relevance"), F.col("prior"), raw, F.col("hits"))).withColumn("score", F.round(raw, 6)).filter(F.col("score") >= min_score)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "chunk_id")))


def why(relevance: Column, prior: Column, score: Column, hits: Column) -> Column:
    """Why a row is evidence, for people: its scores, not yet rounded otherwise, and where it was found.

    Fixed values: the words and the digits of each score."""
    return F.concat(F.lit("相关性 "), fixed(relevance, 3), F.lit(" × 先验 "), fixed(prior, 2), F.lit(" → "), fixed(score, 3), F.lit("；命中 "), F.array_join(hits, ", "))


def routed_evidence(evidence: DataFrame) -> DataFrame:
    """evidence (with hits and n_routes, the plan's sub-queries) with each sub-query's best row that is not yet in front put
    in front, in the sub-queries' order, where the plan has two or more; the others keep theirs.

    A query has at most CAP rows; who leads is a fold over its sub-queries.
    """
    subs = F.array_distinct(F.transform("hits", lambda h: F.substring_index(h, "/", 1)))
    rows = evidence.filter("n_routes > 1").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", subs.alias("subs")))).alias("rows"))
    every = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["subs"]))))
    first = lambda done, sub: F.slice(F.filter("rows", lambda r: F.array_contains(r["subs"], sub) & ~F.array_contains(done, r["place"])), 1, 1)
    leads = F.aggregate(every, F.array().cast("array<int>"), lambda done, sub: F.concat(done, F.transform(first(done, sub), lambda r: r["place"].cast("int"))))
    led = rows.select("query_id", F.posexplode(leads).alias("_at", "place"))
    e = evidence.join(led, ["query_id", "place"], "left")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("_at"), "place")
    return e.withColumn("place", F.row_number().over(order)).select(*evidence.columns)


def hit_window(parents: DataFrame) -> DataFrame:
    """Children of a parent that are hit, or next to a hit; the first child where none is."""
    w = Window.partitionBy("query_id", "parent_id").orderBy("chunk_index")
    near = F.max(F.col("hit").cast("int")).over(w.rowsBetween(-1, 1)) == 1
    none = F.max(F.col("hit").cast("int")).over(Window.partitionBy("query_id", "parent_id")) == 0
    return parents.withColumn("keep", near | (none & (F.row_number().over(w) == 1))).filter("keep").drop("keep")


def parent_text(children: DataFrame) -> DataFrame:
    """(parent_id, n_children, text): children in order, joined by blank lines."""
    kids = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return children.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_children"), F.array_join(F.transform(kids, lambda x: x["text"]), "\n\n").alias("text"))


def _label(seqs: list[int], path_of: dict[int, str]) -> str:
    """A section's range: the first path and, where there are more, the last."""
    paths = [path_of[s] for s in seqs if path_of.get(s)]
    return paths[0] if len(paths) == 1 else f"{paths[0]} … {paths[-1]}" if paths else ""


def assemble(evidence: DataFrame, children: DataFrame, top_k: int = TOP_K, budget: int = 3000, widest: int = 3) -> DataFrame:
    """Sections of each query: evidence grouped by parent, adjacent parents merged, within a token budget.

    evidence: query_id, place, score, doc, parent_seq, chunk_index, path, why. Taken in order, a hit on a parent already in
    a group joins it; one next to a group of the same document (of fewer than `widest` parents) extends it; others open
    a group while there are fewer than top_k, else are skipped without a trace, so a later hit may still join. A group
    over the remaining budget is cut to its hits and their neighbours; if that is over, too, assembly ends.
    children: doc, parent_seq, chunk_index, n_tokens, text. A section has its first hit's score and reason; `repeated`
    tells that a paragraph occurs in it twice, which a caller may take for an error.
    """

    def grouped(rows: pd.DataFrame) -> pd.DataFrame:
        members: dict[tuple[str, int], int] = {}  # parent -> its group
        sizes: list[int] = []
        heads: list = []
        hits: dict[tuple[str, int], list[int]] = {}
        path_of: dict[int, dict[int, str]] = {}
        for r in rows.sort_values("place").itertuples():
            parent = (r.doc, r.parent_seq)
            beside = [g for s in (-1, 1) if (g := members.get((r.doc, r.parent_seq + s))) is not None and sizes[g] < widest]
            group = members.get(parent, min(beside, default=len(sizes)))
            if group == len(sizes):
                if group >= top_k:
                    continue
                sizes.append(0)
                heads.append(r)
            if parent not in members:
                members[parent] = group
                sizes[group] += 1
                path_of.setdefault(group, {})[r.parent_seq] = r.path
            hits.setdefault(parent, []).append(r.chunk_index)
        label = {g: _label(sorted(p), p) for g, p in path_of.items()}
        out = [(heads[g].query_id, g, doc, seq, heads[g].score, label[g], heads[g].why, hits[doc, seq]) for (doc, seq), g in members.items()]
        return pd.DataFrame(out, columns=["query_id", "section", "doc", "parent_seq", "score", "label", "why", "hits"])

    g = evidence.groupBy("query_id").applyInPandas(grouped, "query_id long, section int, doc string, parent_seq long, score double, label string, why string, hits array<int>")
    kids = g.join(children, ["doc", "parent_seq"])
    near = F.exists("hits", lambda h: F.abs(h - F.col("chunk_index")) <= 1)
    line = F.array_sort(F.collect_list(F.struct("parent_seq", "chunk_index", "text", "n_tokens", near.alias("near"))))
    sections = kids.groupBy("query_id", "section", "doc", "score", "label", "why").agg(line.alias("lines"))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in rows.sort_values("section").itertuples():
            lines = list(r.lines)
            if sum(x["n_tokens"] for x in lines) > left:
                lines = [x for x in lines if x["near"]]
            n = sum(x["n_tokens"] for x in lines)
            if n > left:
                break
            left -= n
            texts = [x["text"] for x in lines]
            out.append((r.query_id, r.section, r.doc, r.score, r.label, r.why, int(n), len(set(texts)) < len(texts), "\n\n".join(texts)))
        return pd.DataFrame(out, columns=["query_id", "section", "doc", "score", "label", "why", "n_tokens", "repeated", "text"])

    return sections.groupBy("query_id").applyInPandas(fitted, "query_id long, section int, doc string, score double, label string, why string, n_tokens long, repeated boolean, text string")

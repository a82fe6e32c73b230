"""Mixing sources to target weights with DataFrame and SQL functions only.

Every source's documents fall into hashed blocks. A source is taken whole as often as its target allows, and the
rest of its target is drawn as a prefix of its permuted blocks, the last one cut to the word. The blocks taken are
exact quotas, which a multivariate-hypergeometric splitting tree halves again and again among the output shards;
each shard then gets its own run of every source's permuted blocks, and its rows are put in the order of a hash. The
number of shards follows the corpus. Sources are ranked in one task and their quotas are one row: there may be some
hundred thousand of them, while documents and blocks are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistra.llm._common import WORD, materialize

#: Blocks of a source, seed of all draws.
BLOCKS, SEED = 4096, 20
#: Levels of the splitting tree at least and at most (2 ** levels output shards), words of a shard aimed at.
LEVELS, MOST_LEVELS, SHARD_WORDS = 4, 12, 1 << 26
#: Pieces of a shard, by position, that are sorted by tasks of their own.
PIECES_BITS = 4
WEIGHTS, CAP = (1, 2, 3), 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """docs with _size (words), _source (a key that is never null), _mark (the text's hash) and _block."""
    return (
        docs.withColumn("_size", n_words(docs["text"]))
        .withColumn("_source", F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("null")))
        .withColumn("_mark", F.xxhash64(docs["text"]))
        .withColumn("_block", F.pmod(F.xxhash64(F.lit(SEED), docs["doc_id"], F.col("_mark")), F.lit(BLOCKS)).cast("int"))
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(_source, source_size, target): targets share the sum of all sizes by weight, none above cap times its source.

    sizes has one row per source. Filling from the source with the lowest cap per weight upwards, the first one
    that its share doesn't overfill sets the level for all that follow.
    """
    order = Window.orderBy(F.when(F.col("_source") == "null", 1).otherwise(0), "_source")
    w = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(1))
    w = w.withColumn("_level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(fill), F.lit(0.0))) / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(fill), F.lit(0.0))))
    w = w.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_source", "_level"))).over(all_)["_level"])
    return w.select("_source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


#: One draw: how many of K marked among N items are in n of them. Two passes over a window of 12 deviations around
#: the mean: the first sums the weights, the second stops at the uniform number's share of them.
_STEP = "ln(greatest(({K} - k) * ({n} - k), 1e-300D)) - ln((k + 1D) * greatest({N} - {K} - {n} + k + 1D, 1e-300D))"
_LOW = "cast(greatest(0D, {n} - ({N} - {K}), floor({n} * {K} / {N} - 12 * {sd} - 2)) as bigint)"
_HIGH = "cast(least({n}, {K}, ceil({n} * {K} / {N} + 12 * {sd} + 2)) as bigint)"
_SD = "sqrt({n} * {K} / {N} * ({N} - {K}) / {N} * ({N} - {n}) / greatest({N} - 1D, 1D))"


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for a hypergeometric number; the arguments are SQL doubles."""
    names = {"N": total, "K": marked, "n": drawn}
    names["sd"] = "(" + _SD.format(**names) + ")"
    low, high, step = (x.format(**names) for x in (_LOW, _HIGH, _STEP))
    start = "(low + 0D)"
    mass = f"""aggregate(sequence(low, high), named_struct('l', 0D, 'm', 0D, 's', 0D),
        (t, k) -> named_struct('l', t.l + {step}, 'm', greatest(t.m, t.l), 's', t.s * exp(t.m - greatest(t.m, t.l)) + exp(t.l - greatest(t.m, t.l))), t -> t)"""
    pick = f"""aggregate(sequence(low, high), named_struct('l', 0D, 'c', 0D, 'x', high, 'done', false),
        (t, k) -> if(t.done, t, named_struct('l', t.l + {step}, 'c', t.c + exp(t.l - z.m), 'x', k, 'done', t.c + exp(t.l - z.m) >= {uniform} * z.s)), t -> t.x)"""
    return f"""if({total} <= 0 or {marked} <= 0 or {drawn} <= 0, 0L,
        element_at(transform(array(named_struct('low', {low}, 'high', {high})),
          w -> element_at(transform(array({mass.replace('low', 'w.low').replace('high', 'w.high')}),
            z -> {pick.replace('low', 'w.low').replace('high', 'w.high')}), 1)), 1))""".replace(start, "w.low")


def splitting_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(shard, quotas): quotas is one row with `quotas array<long>`, a source's blocks each; every shard gets an equal
    number of blocks (up to one) and each source's blocks add up to its quota. Sources stay a config-sized list.
    """
    draw = hypergeometric("cast(a.total as double)", "cast(quotas[i] as double)", "cast(a.room as double)", f"((pmod(xxhash64({seed}, shard, i, size(quotas)), 1048576) + 0.5D) / 1048576)")
    left = f"""aggregate(sequence(0, size(quotas) - 1), named_struct('total', total, 'room', total div 2, 'out', cast(array() as array<bigint>)),
        (a, i) -> element_at(transform(array({draw}), x -> named_struct('total', a.total - quotas[i], 'room', a.room - x, 'out', concat(a.out, array(x)))), 1), a -> a.out)"""
    out = quotas.select(F.lit(1).alias("shard"), "quotas")
    for _ in range(levels):
        out = out.selectExpr("shard", "quotas", "aggregate(quotas, 0L, (x, y) -> x + y) as total").selectExpr("shard", "quotas", f"{left} as low")
        out = out.selectExpr("inline(array(named_struct('shard', 2 * shard, 'quotas', low), named_struct('shard', 2 * shard + 1, 'quotas', transform(quotas, (q, i) -> q - low[i]))))")
    return out.select((F.col("shard") - (1 << levels)).alias("shard"), "quotas")


def block_plan(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """What each block gives: (_source, _block, source_size, target, whole, left, shards).

    whole: times it is taken in full; left: words of one more pass, up to all of them; shards: one per pass.
    """
    blocks = narrow.groupBy("_source", "_block").agg(F.sum("_size").alias("words"))
    sizes = blocks.groupBy("_source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, cap).withColumn("want", F.least(F.round("target").cast("long"), F.col("source_size") * cap))
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size"))
    rank = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(SEED + 1), "_block"), "_block")
    b = blocks.join(goal, "_source").withColumn("before", F.coalesce(F.sum("words").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = b.withColumn("left", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before"))))
    b = b.withColumn("passes", F.col("whole") + (F.col("left") > 0).cast("int"))
    b = materialize(b.drop("before", "rest", "want"), "blocks")
    quotas = b.groupBy("_source").agg(F.sum("passes").alias("q")).agg(F.array_sort(F.collect_list(F.struct("_source", "q"))).alias("s"))
    total = b.agg(F.sum(F.col("whole") * F.col("words") + F.col("left")).alias("n")).first()["n"] or 0
    levels = min(MOST_LEVELS, max(LEVELS, (total // SHARD_WORDS).bit_length()))
    tree = splitting_tree(quotas.select(F.transform("s", lambda x: x["q"]).alias("quotas")), levels)
    per_shard = tree.select("shard", F.posexplode("quotas").alias("i", "n")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("by"))
    ends = quotas.select(F.posexplode("s").alias("i", "s")).join(per_shard, "i").select(
        F.col("s._source").alias("_source"),
        F.expr("transform(by, (x, k) -> aggregate(slice(by, 1, k + 1), 0L, (t, y) -> t + y.n))").alias("ends"),
    )
    each = b.filter("passes > 0").select("_source", "_block", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
    each = each.withColumn("at", F.row_number().over(Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(SEED + 2), "_block", "pass"), "_block", "pass")) - 1)
    each = each.join(ends, "_source").withColumn("shard", F.expr("size(filter(ends, e -> e <= at))"))
    dealt = each.groupBy("_source", "_block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    return b.join(dealt, ["_source", "_block"], "left").select("_source", "_block", "source_size", "target", "whole", "left", F.transform("dealt", lambda x: x["shard"]).alias("shards"))


def taken(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs (as sized() gives them) with source_size, target, taken and shards, an entry for each time it is taken."""
    # the order within a block must not depend on which columns docs has
    rank = Window.partitionBy("_source", "_block").orderBy(F.xxhash64(F.lit(SEED + 3), "doc_id", "_mark"), "doc_id", "_size", "_mark").rowsBetween(Window.unboundedPreceding, -1)
    d = docs.join(plan, ["_source", "_block"]).withColumn("_before", F.coalesce(F.sum("_size").over(rank), F.lit(0)))
    d = d.withColumn("_part", F.greatest(F.lit(0), F.least("_size", F.col("left") - F.col("_before"))))
    d = d.withColumn("taken", F.col("whole") * F.col("_size") + F.col("_part"))
    times = F.col("whole") + (F.col("_part") > 0).cast("int")
    return d.withColumn("shards", F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), times)).drop("_before", "left")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of every row.

    Null texts have size 0 and are taken no words of; a null source is a source of its own, last in order. Repeated
    rows are separate documents. An empty table gives an empty result. Every source's taken words add up to its
    target rounded to a word.
    """
    narrow = materialize(sized(docs.select("doc_id", "text", "source")).select("doc_id", "_size", "_source", "_mark", "_block"), "sized")
    out = taken(narrow, block_plan(narrow))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"), "shards")


def mix(docs: DataFrame) -> DataFrame:
    """(row, shard, position): the mixed rows with docs' columns in row, once each time a document is taken.

    A document that a quota cuts keeps its first words, joined by single spaces. The text is unchanged otherwise.
    position is a hash of the document and of which time it is taken; a task holds a shard's rows, or a range of their
    positions, in the order of positions, so what is written is shuffled. Null texts have no words and are not taken.
    """
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # no name of docs can clash with those used here
    full = sized(docs.select(*(docs[f"`{c}`"].alias(o) for c, o in own.items()), "doc_id", "text", "source")).drop("text", "source")
    plan = block_plan(materialize(full.select("doc_id", "_size", "_source", "_mark", "_block"), "sized"))
    rows = taken(full, plan).select("*", F.posexplode("shards").alias("_time", "shard"))
    cut = (F.col("_time") == F.col("whole")) & (F.col("_part") < F.col("_size"))
    text = F.col(own["text"])
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_part").cast("int")), " ")
    values = {c: F.col(o) for c, o in own.items()} | {"text": F.when(cut, first).otherwise(text)}
    if "n_chars" in own:
        values["n_chars"] = F.when(cut, F.length(first)).otherwise(F.col(own["n_chars"])).cast("long")
    row = F.struct(*(v.alias(c) for c, v in values.items()))
    order = F.xxhash64(F.lit(SEED + 4), "shard", "doc_id", "_mark", "_time")
    placed = rows.select(row.alias("row"), "shard", order.alias("position"))
    return placed.repartition("shard", F.shiftright("position", 64 - PIECES_BITS)).sortWithinPartitions("shard", "position")

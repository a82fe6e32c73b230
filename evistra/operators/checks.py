"""Integrity checks that return their violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evistra.functions import text


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that is not true of a row."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*failed))).alias("rule"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of non-null keys that occur more than once."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """(key, n) of non-null references without a target."""
    return df.filter(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias(key)), key, "left_anti").groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def array_errors(df: DataFrame, key: list[str], found: dict[str, Column]) -> DataFrame:
    """(key, error) for each of the conditions that is true of a row; null counts as not true."""
    named = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in found.items()]
    return df.select(*key, F.explode(F.array_compact(F.array(*named))).alias("error"))


#: Of each outcome the verdict it needs, the ledger's decision, the tool that must and the one that must not run.
OUTCOMES = {
    "approved": ("通过", "批准", "execute_refund", "record_refund_denial"),
    "denied": ("不通过", "拒绝", "record_refund_denial", "execute_refund"),
    "clarify": ("需补充", None, None, None),
    "ask_order_id": (None, None, None, None),
}
FINAL_TOOLS = ("execute_refund", "record_refund_denial")


def expectation_errors(turns: DataFrame) -> DataFrame:
    """(case_id, pos, error): what is wrong with turns' expectations.

    turns: case_id, pos, outcome; anchor (struct verdict, amount, fragments, order_id; null without one), rule (struct
    verdict, amount, reason: what the rules say of the anchor's request); log (struct decision, order_id, amount, or
    null); must_call, must_not_call, call_order, mention, not_mention (arrays), must_include_receipt. A turn with an
    unknown outcome is checked no further.
    """
    c, o = F.col, F.col("outcome")
    spec = lambda i: _from({k: v[i] for k, v in OUTCOMES.items()}, o)
    verdict, decision, must, forbid = spec(0), spec(1), spec(2), spec(3)
    anchored, logged = c("anchor").isNotNull(), c("log").isNotNull()
    near = lambda a, b: F.abs(a - b) <= 1e-6
    known = o.isin(*OUTCOMES)
    final = F.array(*map(F.lit, FINAL_TOOLS))
    found = {
        "anchor missing": verdict.isNotNull() & ~anchored,
        "verdict differs": anchored & (c("rule.verdict") != c("anchor.verdict")),
        "reason lacks a fragment": anchored & F.exists("anchor.fragments", lambda f: ~F.contains(c("rule.reason"), f)),
        "amount differs": anchored & ~near(c("rule.amount"), c("anchor.amount")),
        "outcome against verdict": anchored & (c("anchor.verdict") != verdict),
        "log missing": decision.isNotNull() & ~logged,
        "log direction": logged & (c("log.decision") != decision),
        "log order": logged & decision.isNotNull() & anchored & (c("log.order_id") != c("anchor.order_id")),
        "approved amount": logged & (o == "approved") & anchored & ~near(c("log.amount"), c("anchor.amount")),
        "denied amount": logged & (o == "denied") & ~near(c("log.amount"), F.lit(0.0)),
        "log unwanted": logged & decision.isNull(),
        "must lacks tool": must.isNotNull() & ~F.array_contains("must_call", must),
        "forbid lacks tool": forbid.isNotNull() & ~F.array_contains("must_not_call", forbid),
        "final tool wanted": decision.isNull() & F.arrays_overlap("must_call", final),
        "final tool allowed": decision.isNull() & (F.size(F.array_except(final, c("must_not_call"))) > 0),
        "tools overlap": F.arrays_overlap("must_call", "must_not_call"),
        "order beyond must": F.size(F.array_except("call_order", "must_call")) > 0,
        "receipt flag": c("must_include_receipt") != decision.isNotNull(),
        "mentions overlap": F.arrays_overlap("mention", "not_mention"),
    }
    return array_errors(turns, ["case_id", "pos"], {"unknown outcome": ~known} | {k: known & bad for k, bad in found.items()})


def _from(values: dict[str, str | None], c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, F.lit(v).cast("string")).otherwise(out)
    return out


def case_errors(cases: DataFrame, customers: DataFrame) -> DataFrame:
    """(case_id, line, error, other) of cases (line, case_id, request_id, source, customer_id, n_turns): repeated ids, a
    request id that an earlier case has (other: the last one before), another source than eval, an unknown customer, no turns."""
    repeated = F.row_number().over(Window.partitionBy("case_id").orderBy("line")) > 1
    holder = F.lag("case_id").over(Window.partitionBy("request_id").orderBy("line"))
    c = cases.withColumn("repeated", repeated).withColumn("holder", holder)
    c = c.join(customers.select("customer_id", F.lit(True).alias("there")), "customer_id", "left")
    found = {
        "case repeated": F.col("repeated"), "request repeated": F.col("holder").isNotNull(), "source": F.coalesce(F.col("source"), F.lit("")) != "eval",
        "customer unknown": F.col("there").isNull(), "no turns": F.col("n_turns") == 0,
    }
    out = array_errors(c, ["case_id", "line", "holder"], found)
    return out.select("case_id", "line", "error", F.when(F.col("error") == "request repeated", F.col("holder")).alias("other"))


def retrieval_case_errors(cases: DataFrame, bodies: DataFrame, lead: int = 8) -> DataFrame:
    """(line, case_id, error, detail) of cases (line, case_id, question, ground_truth, source array) against bodies (chunk_id, body).

    A case with a missing or empty field is checked no further. Ids and questions repeat those of an earlier line
    (detail: the last case before with the question, which is compared trimmed); a short first sentence stands alone;
    sources must exist, and if they do, numbers of the answer must occur in them.
    """
    fields = ("case_id", "question", "ground_truth", "source")
    empty = {f: F.coalesce(F.size(f) == 0 if f == "source" else F.col(f).cast("string") == "", F.lit(True)) for f in fields}
    lacking = F.array_compact(F.array(*(F.when(bad, F.lit(f)) for f, bad in empty.items())))
    c = cases.withColumn("lacking", lacking)
    missing = c.filter(F.size("lacking") > 0).select("line", "case_id", F.lit("fields").alias("error"), F.array_join("lacking", ",").alias("detail"))
    c = c.filter(F.size("lacking") == 0)
    asked = F.regexp_replace("question", r"(?U)^\s+|\s+$", "")
    c = c.withColumn("asked", asked)
    c = c.withColumn("repeated", F.row_number().over(Window.partitionBy("case_id").orderBy("line")) > 1)
    c = c.withColumn("holder", F.lag("case_id").over(Window.partitionBy("asked").orderBy("line")))
    parts = text.sentences(F.col("ground_truth"))
    first = F.get(parts, F.lit(0))
    ids = c.select("line", F.explode(F.array_distinct("source")).alias("chunk_id")).join(bodies.select("chunk_id", "body"), "chunk_id", "left")
    ids = ids.select("line", "chunk_id", F.col("body").isNull().alias("gone"), F.explode_outer(text.numbers(F.col("body"))).alias("number"))
    src = ids.groupBy("line").agg(F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("chunk_id")))).alias("unknown"), F.collect_set("number").alias("numbers"))
    c = c.join(src, "line")
    invented = F.array_sort(F.array_except(text.numbers(F.col("ground_truth")), "numbers"))
    some = lambda name, bad, detail: F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(name).alias("error"), detail.alias("detail")))
    found = F.array(
        some("case repeated", F.col("repeated"), F.lit("")), some("question repeated", F.col("holder").isNotNull(), F.col("holder").cast("string")),
        some("short lead", (F.size(parts) > 1) & (F.length(first) <= lead), first), some("unknown source", F.size("unknown") > 0, F.array_join(F.transform("unknown", lambda x: x.cast("string")), ",")),
        some("invented number", (F.size("unknown") == 0) & (F.size(invented) > 0), F.array_join(invented, ",")),
    )
    return missing.union(c.select("line", "case_id", F.explode(F.array_compact(found)).alias("e")).select("line", "case_id", "e.error", "e.detail"))

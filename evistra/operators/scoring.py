"""Scores of turns and cases: what an agent did, held against what was expected of it.

A turn has tools (array of names), verdicts and policy (what the eligibility check and the policy search answered),
log (array of struct decision, receipt, order_id, amount), and answer. An expectation has outcome, must_call,
must_not_call and call_order (arrays), max_searches, must_include_receipt, expected_log (a log row or null), mention,
not_mention and prefer_docs (arrays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evistra.functions.text import receipts

#: Names of tools, verdicts and what they lead to, decisions of the ledger.
CHECK, SEARCH, REFUND, DENIAL = "check_refund_eligibility", "search_refund_policy", "execute_refund", "record_refund_denial"
TERMINAL, HANDOFF = (REFUND, DENIAL), ("handoff_to_human", "transfer_to_human")
OUTCOME_OF = {"通过": "approved", "不通过": "denied", "需补充": "clarify"}
APPROVED, DENIED = "批准", "拒绝"
FAILED_PREFIX, CUSTOMER_PREFIX, COLON = "操作失败：", "客户 ", "："
HARD = ("decision_match", "rule_consistency", "tool_sequence", "receipt_in_answer", "log_match", "no_leak")
SOFT = ("mention_hit", "citation_hit", "search_economy")


def bare(c: Column) -> Column:
    """Without any white space; null is empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def _one(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def outcome(tools: Column, log: Column) -> Column:
    """handoff by tool; else by the last ledger row; else by whether any tool was used."""
    by_log = F.when(F.try_element_at(log, F.lit(-1))["decision"] == APPROVED, "approved").otherwise("denied")
    asked = F.when(F.size(tools) == 0, "ask_order_id").otherwise("clarify")
    return F.when(F.exists(tools, lambda t: t.isin(*HANDOFF)), "handoff").when(F.size(log) > 0, by_log).otherwise(asked)


def last_verdict_text(verdicts: Column) -> Column:
    """The last answer of the check that is a verdict (others tell of wrong arguments); null without one."""
    return F.try_element_at(F.filter(verdicts, lambda v: F.substring_index(v, COLON, 1).isin(*OUTCOME_OF)), F.lit(-1))


def implied(verdict: Column) -> Column:
    """The outcome that a verdict leads to."""
    out, head = F.lit(None).cast("string"), F.substring_index(verdict, COLON, 1)
    for name, leads in OUTCOME_OF.items():
        out = F.when(head == name, leads).otherwise(out)
    return out


def consistent(tools: Column, log: Column, verdicts: Column) -> Column:
    """The outcome is the last verdict's; without a verdict only asking for the order is."""
    said = last_verdict_text(verdicts)
    return F.when(said.isNull(), outcome(tools, log) == "ask_order_id").otherwise(outcome(tools, log) == implied(said))


def receipt_quoted(log: Column, answer: Column) -> Column:
    return (F.size(log) > 0) & F.contains(bare(answer), F.try_element_at(log, F.lit(-1))["receipt"])


def no_stray_receipt(answer: Column) -> Column:
    return F.size(receipts(bare(answer))) == 0


def action_evidence(tools: Column, log: Column, results: Column) -> Column:
    """The last receipt of the tool that the outcome stands for (results: array of struct tool, text) that isn't a failure."""
    tool = F.when(outcome(tools, log) == "approved", REFUND).when(outcome(tools, log) == "denied", DENIAL)
    fit = F.filter(results, lambda r: (r["tool"] == tool) & ~r["text"].startswith(FAILED_PREFIX))
    return F.coalesce(F.try_element_at(fit, F.lit(-1))["text"], F.lit(""))


def customer_evidence(profile: Column) -> Column:
    """A profile's lines without the one that names the customer."""
    return F.array_join(F.filter(F.split(F.coalesce(profile, F.lit("")), "\n"), lambda x: ~x.startswith(CUSTOMER_PREFIX)), "\n")


def online_scores(turns: DataFrame) -> DataFrame:
    """turns with the outcome and the three scores that need no expectation."""
    tools, log = F.col("tools"), F.col("log")
    ends = F.size(F.filter(tools, lambda t: t.isin(*TERMINAL)))
    quoted = F.when(F.size(log) > 0, receipt_quoted(log, F.col("answer"))).otherwise(no_stray_receipt(F.col("answer")))
    return turns.select(
        "*", outcome(tools, log).alias("outcome"), _one(consistent(tools, log, F.col("verdicts"))).alias("rule_consistency"),
        _one(quoted).alias("receipt_in_answer"), _one((ends == F.size(log)) & (ends <= 1)).alias("log_structure"),
    )


def subsequence(want: Column, got: Column) -> Column:
    """Whether want occurs in got in its order: the next wanted one is looked for from where the last was found."""
    return F.aggregate(got, F.lit(0), lambda p, e: p + F.coalesce(F.get(want, p) == e, F.lit(False)).cast("int")) == F.size(want)


def turn_scores(turns: DataFrame) -> DataFrame:
    """turns joined with their expectations, with six hard scores of 0 or 1 and three soft ones, null without an expectation."""
    tools, log, answer = F.col("tools"), F.col("log"), bare(F.col("answer"))
    first, want = F.get("log", F.lit(0)), F.col("expected_log")
    logged = (F.size(log) == 1) & (first["decision"] == want["decision"]) & (first["order_id"] == want["order_id"]) & (F.abs(first["amount"] - want["amount"]) < 1e-6)
    called = (F.size(F.array_except("must_call", tools)) == 0) & (F.size(F.array_intersect("must_not_call", tools)) == 0)
    evidence = bare(F.array_join("policy", ""))
    share = lambda parts, hit: F.when(F.size(parts) > 0, F.size(F.filter(parts, hit)) / F.size(parts))
    searches = F.size(F.filter(tools, lambda t: t == SEARCH))
    return turns.select(
        "*",
        _one(outcome(tools, log) == F.col("expected_outcome")).alias("decision_match"),
        _one(consistent(tools, log, F.col("verdicts"))).alias("rule_consistency"),
        _one(called & subsequence(F.col("call_order"), tools)).alias("tool_sequence"),
        _one(F.when(F.col("must_include_receipt"), receipt_quoted(log, F.col("answer"))).otherwise(no_stray_receipt(F.col("answer")))).alias("receipt_in_answer"),
        _one(F.when(want.isNull(), F.size(log) == 0).otherwise(logged)).alias("log_match"),
        _one(~F.exists("not_mention", lambda w: F.contains(answer, bare(w)))).alias("no_leak"),
        share(F.col("mention"), lambda w: F.contains(answer, bare(w))).alias("mention_hit"),
        share(F.col("prefer_docs"), lambda d: F.contains(evidence, d)).alias("citation_hit"),
        F.when(F.col("max_searches").isNotNull(), _one(searches <= F.col("max_searches"))).alias("search_economy"),
    )


def case_scores(scored: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a case of `cases` (case_id, run_error, and of a case that was run again replay_rows, replay_receipts,
    expected_rows, same_receipt): a hard score is the least of its turns', a soft one the mean of those that have it;
    with idempotent_replay, case_pass, the hard scores that failed in order, and up to three failed turns of each score
    as comments. A case whose run failed scores 0 in all hard ones and has no soft ones.
    """
    turn = F.format_string("turn %d", F.col("pos"))
    aggs = []
    for m in (*HARD, *SOFT):
        aggs.append((F.min(m) if m in HARD else F.avg(m)).alias(m))
        aggs.append(F.slice(F.array_sort(F.collect_list(F.when(F.col(m) < 1, F.struct("pos", turn.alias("t"))))), 1, 3).alias(f"_{m}"))
    out = cases.join(scored.groupBy("case_id").agg(*aggs), "case_id", "left")
    failed_run = F.col("run_error") > 0
    replay = (F.col("replay_rows") == F.col("expected_rows")) & (~F.col("same_receipt") | (F.size(F.array_distinct("replay_receipts")) <= 1))
    out = out.withColumn("idempotent_replay", F.when(F.col("expected_rows").isNotNull() & ~failed_run, _one(replay)))
    for m in HARD:
        out = out.withColumn(m, F.when(failed_run, 0.0).otherwise(F.col(m)))
    for m in SOFT:
        out = out.withColumn(m, F.when(~failed_run, F.col(m)))
    hard = (*HARD, "idempotent_replay")
    failed = F.array_compact(F.array(*(F.when(F.col(m) < 1, F.lit(m)) for m in hard)))
    comments = F.array_compact(F.array(*(F.when(F.size(f"_{m}") > 0, F.concat(F.lit(f"{m}: "), F.array_join(F.transform(f"_{m}", lambda x: x["t"]), " | "))) for m in (*HARD, *SOFT))))
    out = out.withColumn("failed", failed).withColumn("case_pass", _one(~failed_run & (F.size("failed") == 0)))
    return out.withColumn("comments", F.when(failed_run, F.array().cast("array<string>")).otherwise(comments)).drop(*(f"_{m}" for m in (*HARD, *SOFT)))


def run_rates(cases: DataFrame) -> DataFrame:
    """One row: how many cases, rates of passing in all and of those with priority P0, of failed runs, and the means of
    all scores; 0 where nothing has a value."""
    mean = lambda c, name: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(name)
    return cases.agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("case_pass"), "overall_pass_rate"), mean(F.when(F.col("priority") == "P0", F.col("case_pass")), "p0_pass_rate"),
        mean(F.col("run_error").cast("double"), "error_rate"), *(mean(F.col(m), f"avg_{m}") for m in (*HARD, *SOFT)),
    )

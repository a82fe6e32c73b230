"""Queries of turn and case scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evistra.operators import scoring as S
from evistra.registry import query
from evistra.sources import readers
from evistra.sources.evals import EVAL_SQL, cases_of, expectations_of, turns_of
from evistra.sources.facades import load
from evistra.sources.shared import folder

_LEADS = "CASE verdict WHEN '通过' THEN 'approved' WHEN '不通过' THEN 'denied' WHEN '需补充' THEN 'clarify' END"
_BARE = "regexp_replace(answer, '\\s+', '', 'g')"
_CONSISTENT = f"CAST(coalesce(CASE WHEN verdict IS NULL THEN outcome = 'ask_order_id' ELSE outcome = {_LEADS} END, false) AS DOUBLE)"
_STRAY = f"NOT regexp_matches({_BARE}, '(^|[^A-Za-z0-9_])[RD][0-9]{{4,}}($|[^A-Za-z0-9_])')"
ONLINE_SQL = f"""WITH {EVAL_SQL}
SELECT u AS case_id, pos, outcome, {_CONSISTENT} AS rule_consistency,
  CAST(CASE WHEN n_log > 0 THEN contains({_BARE}, receipt) ELSE {_STRAY} END AS DOUBLE) AS receipt_in_answer,
  CAST(len(list_filter(tools, lambda t: t IN ('execute_refund', 'record_refund_denial'))) = n_log AND n_log <= 1 AS DOUBLE) AS log_structure FROM e_turns"""


@query("L8 ST1 K6 H8 I7", ONLINE_SQL)
def online_turn_scores(spark, sf_dir):
    return S.online_scores(turns_of(spark, sf_dir)).select("case_id", "pos", "outcome", "rule_consistency", "receipt_in_answer", "log_structure")


_SCORED_SQL = f"""WITH {EVAL_SQL},
scored AS (SELECT u AS case_id, pos, CAST(outcome = expected_outcome AS DOUBLE) AS decision_match, {_CONSISTENT} AS rule_consistency,
  CAST(list_has_all(tools, must_call) AND NOT list_has_any(tools, must_not_call) AND (NOT ordered OR coalesce(list_position(tools, 'check_refund_eligibility') > list_position(tools, 'get_customer_info'), false)) AS DOUBLE) AS tool_sequence,
  CAST(CASE WHEN must_include_receipt THEN n_log > 0 AND contains({_BARE}, receipt) ELSE {_STRAY} END AS DOUBLE) AS receipt_in_answer,
  CAST(CASE WHEN want_decision IS NULL THEN n_log = 0 ELSE n_log = 1 AND decision = want_decision AND logged_order = want_order AND abs(logged_amount - want_amount) < 1e-6 END AS DOUBLE) AS log_match,
  CAST(len(list_filter(not_mention, lambda w: contains({_BARE}, replace(w, ' ', '')))) = 0 AS DOUBLE) AS no_leak,
  CASE WHEN len(mention) > 0 THEN len(list_filter(mention, lambda w: contains({_BARE}, replace(w, ' ', '')))) * 1.0 / len(mention) END AS mention_hit,
  CASE WHEN len(prefer_docs) > 0 THEN len(list_filter(prefer_docs, lambda d: contains(replace(array_to_string(policy, ''), ' ', ''), d))) * 1.0 / len(prefer_docs) END AS citation_hit,
  CASE WHEN max_searches IS NOT NULL THEN CAST(len(list_filter(tools, lambda t: t = 'search_refund_policy')) <= max_searches AS DOUBLE) END AS search_economy
  FROM e_turns JOIN e_expected ON k = ek)
"""


def _scored(spark, sf_dir):
    return S.turn_scores(turns_of(spark, sf_dir).join(expectations_of(spark, sf_dir), ["case_id", "pos"]))


@query("L9 C11 H12 I6 I20", _SCORED_SQL + f"SELECT case_id, pos, {', '.join((*S.HARD, *S.SOFT))} FROM scored")
def turn_metrics(spark, sf_dir):
    return _scored(spark, sf_dir).select("case_id", "pos", *S.HARD, *S.SOFT)


_NAMES = (*S.HARD, *S.SOFT)
_SHOWN = ", ".join(
    f"CASE WHEN len(x_{m}) > 0 THEN '{m}: ' || array_to_string(list_transform(x_{m}[1:3], lambda p: 'turn ' || p), ' | ') END" for m in _NAMES
)
_CASES_SQL = _SCORED_SQL.rstrip() + f""",
rolled AS (SELECT case_id, {', '.join(f'min({m}) AS {m}' for m in S.HARD)}, {', '.join(f'avg({m}) AS {m}' for m in S.SOFT)},
  {', '.join(f'coalesce(list(pos ORDER BY pos) FILTER ({m} < 1), []) AS x_{m}' for m in _NAMES)} FROM scored GROUP BY 1),
judged AS (SELECT c.case_id, priority, run_error, {', '.join(f'CASE WHEN run_error = 1 THEN 0 ELSE {m} END AS {m}' for m in S.HARD)}, {', '.join(f'CASE WHEN run_error = 0 THEN {m} END AS {m}' for m in S.SOFT)},
  CASE WHEN expected_rows IS NOT NULL AND run_error = 0 THEN CAST(replay_rows = expected_rows AND len(list_distinct(replay_receipts)) <= 1 AS DOUBLE) END AS idempotent_replay,
  CASE WHEN run_error = 1 THEN [] ELSE list_filter([{_SHOWN}], lambda x: x IS NOT NULL) END AS shown FROM e_cases c LEFT JOIN rolled r ON c.case_id = r.case_id),
results AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {m} < 1 THEN '{m}' END" for m in (*S.HARD, 'idempotent_replay'))}], lambda x: x IS NOT NULL) AS fails FROM judged),
passed AS (SELECT *, CAST(run_error = 0 AND len(fails) = 0 AS DOUBLE) AS case_pass FROM results)
"""


def _cases(spark, sf_dir):
    return S.case_scores(_scored(spark, sf_dir), cases_of(spark, sf_dir))


@query("L10 D-14 D-15 B14 B6", _CASES_SQL + f"""SELECT case_id, case_pass, idempotent_replay, array_to_string(fails, ',') AS failed, array_to_string(shown, '; ') AS comments,
  {', '.join(S.HARD)}, {', '.join(f'round({m}, 6) AS {m}' for m in S.SOFT)} FROM passed""")
def case_results(spark, sf_dir):
    c = _cases(spark, sf_dir)
    return c.select("case_id", "case_pass", "idempotent_replay", F.array_join("failed", ",").alias("failed"), F.array_join("comments", "; ").alias("comments"), *S.HARD, *(F.round(m, 6).alias(m) for m in S.SOFT))


@query("B6", _CASES_SQL + "SELECT case_id, case_pass FROM passed WHERE case_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def selected_cases(spark, sf_dir):
    """The results of a given set of cases: scored for these only, the set being a table of ids."""
    ids = load(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("case_id")).distinct()
    scored = _scored(spark, sf_dir).join(ids, "case_id", "left_semi")
    return S.case_scores(scored, cases_of(spark, sf_dir).join(ids, "case_id", "left_semi")).select("case_id", "case_pass")


@query("A20 B14", _CASES_SQL + "SELECT case_id, case_pass, idempotent_replay, array_to_string(fails, ',') AS failed, count(*) OVER () AS n FROM passed")
def results_kept(spark, sf_dir):
    """A run's results as a JSON-lines sink writes them, with the run's own row beside them, read again and joined."""
    where, c = folder(spark, "results"), _cases(spark, sf_dir).select("case_id", "case_pass", "idempotent_replay", "failed")
    readers.write_json_lines(c.select(F.lit("run-1").alias("run"), "case_id", "case_pass", "idempotent_replay", "failed"), f"{where}/cases")
    cases = readers.json_lines(spark, f"{where}/cases", StructType.fromDDL(f"run string, case_id {dict(c.dtypes)['case_id']}, case_pass {dict(c.dtypes)['case_pass']}, idempotent_replay {dict(c.dtypes)['idempotent_replay']}, failed array<string>"))
    readers.write_json_lines(cases.groupBy("run").agg(F.count(F.lit(1)).alias("n")), f"{where}/run")
    run = readers.json_lines(spark, f"{where}/run", StructType.fromDDL("run string, n long"))
    return cases.join(F.broadcast(run), "run").select("case_id", "case_pass", "idempotent_replay", F.array_join("failed", ",").alias("failed"), "n")


@query("D-13 B7 D-25", _CASES_SQL + f"""SELECT count(*) AS n, coalesce(round(avg(case_pass), 6), 0) AS overall_pass_rate, coalesce(round(avg(case_pass) FILTER (priority = 'P0'), 6), 0) AS p0_pass_rate,
  coalesce(round(avg(run_error), 6), 0) AS error_rate, {', '.join(f'coalesce(round(avg({m}), 6), 0) AS avg_{m}' for m in _NAMES)} FROM passed""")
def case_run_summary(spark, sf_dir):
    return S.run_rates(_cases(spark, sf_dir))


@query("F10", _CASES_SQL + """, ordered AS (SELECT case_id, row_number() OVER (ORDER BY case_pass, coalesce(mention_hit, 0), coalesce(citation_hit, 0), case_id) AS place FROM passed)
SELECT * FROM ordered WHERE place <= 8""")
def worst_cases(spark, sf_dir):
    """The report's list of the eight lowest cases, missing scores as 0: a top-k, not a sort of all."""
    low = ("case_pass", F.coalesce("mention_hit", F.lit(0.0)), F.coalesce("citation_hit", F.lit(0.0)), "case_id")
    top = _cases(spark, sf_dir).select("case_id", *(x.alias(f"o{i}") if not isinstance(x, str) else F.col(x).alias(f"o{i}") for i, x in enumerate(low)))
    top = top.orderBy("o0", "o1", "o2", "o3").limit(8)
    return top.select("case_id", F.row_number().over(Window.orderBy("o0", "o1", "o2", "o3")).alias("place"))


@query("H9 B9 B13", f"""WITH {EVAL_SQL}
SELECT u AS case_id, pos, CASE outcome WHEN 'approved' THEN CASE WHEN k % 2 = 0 THEN 'refund ' || k ELSE 'second refund' END WHEN 'denied' THEN 'denial ' || k ELSE '' END AS action,
  '订单 ' || k || chr(10) || '  item' AS customer FROM e_turns""")
def turn_evidence(spark, sf_dir):
    """What a judge may hold an answer against: the last receipt of the outcome's tool that isn't a failure, and the
    profile without the line that names the customer."""
    text = lambda s: F.concat(F.lit(s), F.col("k").cast("string"))
    result = lambda tool, t: F.struct(F.lit(tool).alias("tool"), t.alias("text"))
    later = F.when(F.col("k") % 2 == 0, "操作失败：again").otherwise("second refund")
    results = F.array(result("execute_refund", text("refund ")), result("execute_refund", later), result("record_refund_denial", text("denial ")), result("record_refund_denial", F.lit("操作失败：no")))
    profile = F.concat(text("客户 C"), F.lit("\n"), text("订单 "), F.lit("\n  item"))
    t = turns_of(spark, sf_dir)
    return t.select("case_id", "pos", S.action_evidence(F.col("tools"), F.col("log"), results).alias("action"), S.customer_evidence(profile).alias("customer"))


@query("B12 A16", f"""WITH {EVAL_SQL} SELECT c.case_id, priority, count(k) AS n_turns, coalesce(string_agg(expected_outcome, '>' ORDER BY pos), '') AS outcomes,
  coalesce(string_agg('O' || k, '>' ORDER BY pos), '') AS asked FROM e_cases c LEFT JOIN (SELECT * FROM e_orders JOIN e_expected ON k = ek) t ON c.case_id = t.u GROUP BY 1, 2""")
def case_round_trip(spark, sf_dir):
    """Cases split into what a run may see (input), what it is held against (expected) and metadata, sent as JSON items
    and put together again."""
    e = orders_asked(spark, sf_dir)
    turn = F.array_sort(F.collect_list(F.struct("pos", "asked", F.struct(F.col("expected_outcome").alias("outcome")).alias("expected"))))
    c = cases_of(spark, sf_dir).select("case_id", "priority").join(e.groupBy("case_id").agg(turn.alias("turns")), "case_id", "left")
    turns = F.coalesce("turns", F.array().cast(c.schema["turns"].dataType))
    item = c.select(
        F.to_json(F.struct(F.transform(turns, lambda t: t.dropFields("expected")).alias("turns"))).alias("input"), F.to_json(F.struct(F.transform(turns, lambda t: t["expected"]).alias("turns"))).alias("expected"),
        F.to_json(F.struct("case_id", "priority")).alias("metadata"),
    )
    back = item.select(
        F.from_json("metadata", "case_id long, priority string").alias("m"), F.from_json("input", "turns array<struct<pos: int, asked: string>>").alias("i"), F.from_json("expected", "turns array<struct<outcome: string>>").alias("e"),
    )
    joined = lambda c: F.array_join(c, ">")
    return back.select("m.case_id", "m.priority", F.size("i.turns").cast("long").alias("n_turns"), joined(F.col("e.turns.outcome")).alias("outcomes"), joined(F.col("i.turns.asked")).alias("asked"))


def orders_asked(spark, sf_dir):
    t = turns_of(spark, sf_dir).select("case_id", "pos", F.concat(F.lit("O"), F.col("k").cast("string")).alias("asked"))
    return t.join(expectations_of(spark, sf_dir).select("case_id", "pos", "expected_outcome"), ["case_id", "pos"])

"""Structured Streaming forms of the monitoring queries, run to the end of what there is (available-now).

Windows and sessions come out once, when the watermark passes them. At the end a closing row, in time after all others,
takes the watermark past those still open, so that each stream gives what the same query gives over the whole table;
the SQL of the batch query is its oracle. State is let go as windows close.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evistra.operators import scoring
from evistra.plans.scoring import ONLINE_SQL
from evistra.registry import query
from evistra.sources.evals import turns_from
from evistra.sources.facades import TURNS_SQL, load, with_tool
from evistra.streaming.history import GAP, Histories, with_histories
from evistra.streaming.runs import drained, stream_of
from evistra.streaming.sinks import CommittedSink


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("ST6 ST5", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS hour, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_ratio FROM events GROUP BY 1
  HAVING avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.02""")
def stream_hourly_alerts(spark, sf_dir):
    e = stream_of(spark, sf_dir, "events", "1 hour")
    w = e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_ratio"))
    rows = drained(e, w.select(F.col("w.start").alias("hour"), "n", "error_ratio"))
    return rows.filter("error_ratio > 0.02").select(_text("hour").alias("hour"), "n", F.round("error_ratio", 6).alias("error_ratio"))


#: The alert rules, by window: name, what it watches, and when it fires.
_RULES = {"hour": {"consistency below 1": "good < 1.0", "error ratio": "bad > 0.02"}, "day": {"consistency below 0.90": "good < 0.9", "structure below 0.85": "structure < 0.85", "slow": "p90 > 90"}}
_WATCH_SQL = """SELECT ts, CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END AS bad, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1 END AS good, CASE WHEN event_type IN ('error', 'signup') THEN 0.0 ELSE 1 END AS structure, value FROM events"""


@query("ST6", f"""WITH w AS ({_WATCH_SQL}),
h AS (SELECT date_trunc('hour', ts) AS t, avg(bad) AS bad, avg(good) AS good FROM w GROUP BY 1), d AS (SELECT date_trunc('day', ts) AS t, avg(good) AS good, avg(structure) AS structure, quantile_disc(value, 0.9) AS p90 FROM w GROUP BY 1)
SELECT strftime(t, '%Y-%m-%d %H') AS at, 'hour' AS size, unnest(list_filter([CASE WHEN good < 1.0 THEN 'consistency below 1' END, CASE WHEN bad > 0.02 THEN 'error ratio' END], lambda x: x IS NOT NULL)) AS rule FROM h
UNION ALL SELECT strftime(t, '%Y-%m-%d %H'), 'day', unnest(list_filter([CASE WHEN good < 0.9 THEN 'consistency below 0.90' END, CASE WHEN structure < 0.85 THEN 'structure below 0.85' END, CASE WHEN p90 > 90 THEN 'slow' END], lambda x: x IS NOT NULL)) FROM d""")
def stream_alert_rules(spark, sf_dir):
    """All alert rules, hourly and daily, as streams: which fire, and when. The percentile is one of the values: the stream
    counts them by parts of a power of two, and one part of each day's values is looked at again."""
    bad, parts = (F.col("event_type") == "error").cast("double"), []
    structure = (~F.col("event_type").isin("error", "signup")).cast("double")
    for size, rules in _RULES.items():
        e = stream_of(spark, sf_dir, "events", "1 hour")
        w = e.groupBy(F.window("ts", f"1 {size}").alias("w")).agg(F.avg(bad).alias("bad"), F.avg(1 - bad).alias("good"), F.avg(structure).alias("structure"))
        w = drained(e, w.select(F.col("w.start").alias("t"), "bad", "good", "structure"))
        w = w.join(stream_percentile(spark, sf_dir, size, 0.9).withColumnRenamed("value", "p90"), "t", "left") if any("p90" in when for when in rules.values()) else w.withColumn("p90", F.lit(None).cast("double"))
        fired = F.array_compact(F.array(*(F.when(F.expr(when), F.lit(name)) for name, when in rules.items())))
        parts.append(w.select(F.date_format("t", "yyyy-MM-dd HH").alias("at"), F.lit(size).alias("size"), F.explode(fired).alias("rule")))
    return parts[0].union(parts[1])


#: Parts of a doubling by which values are counted.
STEPS = 64


def _part(value):
    """A whole number that rises with the value: parts of its power of two, negative ones mirrored, zero between them."""
    size = F.floor(F.log2(F.abs(value)) * STEPS) + 1100 * STEPS
    return F.when(value > 0, size).when(value < 0, -size).when(value.isNotNull(), F.lit(0)).cast("long")


def stream_percentile(spark: SparkSession, sf_dir: str, size: str, share: float) -> DataFrame:
    """(t, value): the smallest value of each window that a share of the window's values don't exceed; exact at any size.

    The stream keeps a window's counts by part, a bounded number of them. When the window has closed, only the values of
    the part that holds the rank are read again, and counted one by one. Null values are left out.
    """
    e = stream_of(spark, sf_dir, "events", "1 hour")
    # nulls, the closing row among them, go after the watermark has seen their time
    counts = e.groupBy(F.window("ts", f"1 {size}").alias("w"), _part(F.col("value")).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    counts = drained(e, counts.select(F.col("w.start").alias("t"), "part", "n")).filter("part is not null")
    upto = F.sum("n").over(Window.partitionBy("t").orderBy("part"))
    rank = F.greatest(F.ceil(F.sum("n").over(Window.partitionBy("t")) * F.lit(share)), F.lit(1))
    hit = counts.withColumn("rank", rank).withColumn("before", upto - F.col("n")).filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n"))).select("t", "part", (F.col("rank") - F.col("before")).alias("rank"))
    rows = load(spark, sf_dir, "events").filter("value is not null").select(F.date_trunc(size, F.col("ts").cast("timestamp")).alias("t"), _part(F.col("value")).alias("part"), "value")
    own = rows.join(hit, ["t", "part"]).groupBy("t", "rank", "value").agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("upto", F.sum("n").over(Window.partitionBy("t").orderBy("value"))).filter(F.col("upto") >= F.col("rank"))
    return own.groupBy("t").agg(F.min("value").alias("value"))


@query("ST6 D-8", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""")
def stream_percentiles(spark, sf_dir):
    """Percentiles of each day's values from a stream's counts."""
    found = None
    for name, share in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
        own = stream_percentile(spark, sf_dir, "day", share).withColumnRenamed("value", name)
        found = own if found is None else found.join(own, "t")
    return found.select(F.date_format("t", "yyyy-MM-dd").alias("day"), "p50", "p90", "p99")


@query("ST3", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedup(spark, sf_dir):
    """Events of which every third is sent twice, each kept once; rows later than the watermark would be dropped, and
    runs.dropped() counts them."""
    e = stream_of(spark, sf_dir, "events", "1 day")
    sent = e.select("event_id", "user_id", "ts", "event_type", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time"))
    once = sent.dropDuplicatesWithinWatermark(["event_id"]).filter("event_id is not null")
    return drained(e, once.select("event_id", "user_id", _text("ts").alias("ts"), "event_type"))


@query("A15 A23 ST3", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_committed(spark, sf_dir):
    """Receipts written exactly once: each batch's rows are committed with its number, keyed by event."""
    e = stream_of(spark, sf_dir, "events")
    rows = e.filter(F.col("event_type").isin("purchase", "error")).select("event_id", "user_id", "event_type", "value")
    sink = CommittedSink(spark, rows.schema, ["event_id"])
    sink.run(rows)
    return sink.rows()


@query("ST2", """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, before) AS n FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS ended, count(*) AS n FROM s GROUP BY user_id, s.n""")
def stream_sessions(spark, sf_dir):
    e = stream_of(spark, sf_dir, "events", "1 hour")
    s = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return drained(e, s.select("user_id", _text("w.start").alias("started"), _text("w.end").alias("ended"), "n"))


@query("ST2 ST4", f"""WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL {GAP} SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e)
SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS n_history, CAST(count(*) FILTER (event_type = 'error') OVER w AS BIGINT) AS n_errors,
  md5(string_agg(CAST(event_id AS VARCHAR), ',') OVER w) AS history FROM s WINDOW w AS (PARTITION BY user_id, n ORDER BY ts, event_id)""")
def stream_history(spark, sf_dir):
    """The session's history as it stands at every turn, kept as list and map state; a timer lets it go when the session
    ends, 30 minutes after its last turn."""
    e = stream_of(spark, sf_dir, "events", "1 hour")
    return drained(e, Histories.of(e), manage=with_histories)


@query("ST1", ONLINE_SQL.replace("u AS case_id, pos, outcome", "k, u AS case_id, outcome"))
def stream_turn_scores(spark, sf_dir):
    """Every turn's outcome and online scores as it comes in: no state, so each is given once and at once."""
    o = stream_of(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("case_id"), F.col("o_totalprice").cast("double").alias("price"))
    return drained(o, scoring.online_scores(turns_from(o)).select("k", "case_id", "outcome", "rule_consistency", "receipt_in_answer", "log_structure"))


@query("ST4 ST3 K4", f"""WITH {TURNS_SQL},
a AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'k' || (event_id % 11) END AS key, CASE WHEN tool = 'execute_refund' THEN 'R' ELSE 'D' END AS letter FROM acts WHERE tool IN ('execute_refund', 'record_denial')),
f AS (SELECT *, min(seq) OVER (PARTITION BY session, CASE WHEN key = '' THEN 'seq' || seq ELSE key END) AS first FROM a),
n AS (SELECT session, seq AS first, letter || (8999 + row_number() OVER (PARTITION BY session ORDER BY seq)) AS receipt FROM f WHERE first = seq)
SELECT f.session, f.seq, f.first <> f.seq AS replayed, receipt FROM f JOIN n ON f.session = n.session AND f.first = n.first""")
def stream_ledger(spark, sf_dir):
    """A ledger a session, kept as the session's state over the batches: its next number and the receipts by key."""
    e = with_tool(stream_of(spark, sf_dir, "events")).filter(F.col("tool").isin("execute_refund", "record_denial"))
    key = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit("k"), (F.col("event_id") % 11).cast("string")))
    a = e.select(F.col("user_id").cast("long").alias("session"), F.col("event_id").cast("long").alias("seq"), key.alias("key"), F.when(F.col("tool") == "execute_refund", "R").otherwise("D").alias("letter"))

    def step(session: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, keys, receipts = state.get if state.exists else (9000, [], [])
        known, out = dict(zip(keys, receipts)), []
        for r in pd.concat(frames).sort_values("seq").itertuples():
            receipt = known.get(r.key) if r.key else None
            out.append((session[0], r.seq, receipt is not None, receipt or f"{r.letter}{n}"))
            if receipt is None:
                n += 1
                if r.key:
                    known[r.key] = out[-1][3]
        state.update((n, list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["session", "seq", "replayed", "receipt"])

    done = a.groupBy("session").applyInPandasWithState(step, "session long, seq long, replayed boolean, receipt string", "n int, keys array<string>, receipts array<string>", "append", GroupStateTimeout.NoTimeout)
    return drained(e, done)

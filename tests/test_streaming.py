"""Streams over one file, a folder and several batches: their rows, what they drop, and the state they let go."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from evistra import registry
from evistra.streaming.history import Histories, with_histories
from evistra.streaming.runs import drained, dropped, held, stream_of
from evistra.streaming.sinks import CommittedSink


@pytest.fixture(params=["file", "folder"])
def events(request, spark, sf, tmp_path):
    if request.param == "file":
        return sf
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.fixture
def in_order(spark, sf, tmp_path):
    """The events in four files, each after the one before."""
    e = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id")
    rows = e.collect()
    for i in range(4):
        part = rows[len(rows) * i // 4 : len(rows) * (i + 1) // 4]
        spark.createDataFrame(part, e.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_stream_hourly_alerts_gives_the_rows_of_its_sql(spark, sf, events):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    want = con.execute(f"SELECT strftime(hour, '%Y-%m-%d %H'), n, error_ratio FROM ({registry.ORACLE_SQL['hourly_alerts']})").fetchall()
    got = registry.QUERIES["stream_hourly_alerts"](spark, events).selectExpr("substring(hour, 1, 13)", "n", "error_ratio").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_stream_sessions_holds_every_event(spark, sf, events):
    last: dict = {}
    want = []
    for r in sorted(spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts").collect(), key=lambda r: r.ts):
        s = last.get(r.user_id)
        if s is None or r.ts >= s[2]:
            s = last[r.user_id] = [r.user_id, r.ts, None, 0]
            want.append(s)
        s[2], s[3] = r.ts + datetime.timedelta(minutes=30), s[3] + 1
    got = registry.QUERIES["stream_sessions"](spark, events).selectExpr("user_id", "cast(started as timestamp_ntz) s", "cast(ended as timestamp_ntz) e", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_dedup_holds_every_event_once(spark, sf, events):
    want = spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().collect()
    got = registry.QUERIES["stream_dedup"](spark, events).select("event_id").collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in want)


def _windows(e):
    return e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("w.start", "n")


def test_windows_close_batch_by_batch_and_let_their_state_go(spark, sf, in_order):
    progress: list = []
    e = stream_of(spark, in_order, "events", "1 hour", files=1)
    got = drained(e, _windows(e), progress=progress)
    want = _windows(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hours = want.count()
    assert dropped(progress) == 0 and len(held(progress)) >= 5
    assert held(progress)[-1] == 1 and max(held(progress)) < hours  # the closing row's window; never all of them


def test_late_rows_are_counted(spark, sf, tmp_path):
    """A batch drops what is later than the watermark that the batch before began with."""
    e = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    rows = e.collect()
    late = rows[:7]
    for part in (rows[7:500], rows[500:], late):
        spark.createDataFrame(part, e.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    progress: list = []
    s = stream_of(spark, str(tmp_path), "events", "1 hour", files=1)
    got = drained(s, s.groupBy(F.window("ts", "1 hour").alias("w"), "event_id").agg(F.count(F.lit(1)).alias("n")).select("event_id", "n"), progress=progress)
    assert got.agg(F.sum("n")).first()[0] == len(rows) - 7 and dropped(progress) == 7


def test_history_over_several_batches_is_that_of_the_batch_window(spark, sf, in_order):
    duckdb = pytest.importorskip("duckdb")
    progress: list = []
    e = stream_of(spark, in_order, "events", "1 hour", files=1)
    got = drained(e, Histories.of(e), with_histories, progress)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    want = con.execute(f"SELECT user_id, event_id, n_history, n_errors, history FROM ({registry.ORACLE_SQL['stream_history']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert held(progress)[-1] == 0 and max(held(progress)) > 0


def test_history_of_one_user_with_ties_nulls_and_a_gap(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    minutes = [(1, 0, "error"), (2, 0, None), (3, 29, "error"), (4, 59, "click"), (5, 70, "error")]
    rows = [(i, at + datetime.timedelta(minutes=m), 7, kind) for i, m, kind in minutes] + [(9, at, None, "error")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    e = stream_of(spark, str(tmp_path), "events", "1 hour")
    got = drained(e, Histories.of(e), with_histories).orderBy("event_id").collect()
    assert [(r.event_id, r.n_history, r.n_errors) for r in got] == [(1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 1, 0), (5, 2, 1)]


def test_a_stop_between_write_and_commit_changes_nothing(spark, sf, in_order):
    e = stream_of(spark, in_order, "events", files=1)
    rows = e.filter("event_id is not null").select("event_id", "value")
    sink, calls = CommittedSink(spark, rows.schema, ["event_id"]), []

    def stop() -> None:
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped between write and commit")

    with pytest.raises(Exception, match="stopped between"):
        sink.run(rows, stop)
    done = sink.commits().count()
    assert done == 1 and sink.rows().count() < spark.read.parquet(f"{sf}/events.parquet").count()
    sink.run(rows)
    want = sorted(map(tuple, spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value").collect()))
    assert sorted(map(tuple, sink.rows().collect())) == want
    again = spark.createDataFrame([(-1, 0.0)], rows.schema)
    sink.write(again, 0)  # a batch that has been committed
    assert sorted(map(tuple, sink.rows().collect())) == want


def test_keys_of_a_sink_keep_their_first_row(spark):
    sink = CommittedSink(spark, spark.createDataFrame([], "k long, v string").schema, ["k"])
    assert sink.rows().count() == 0
    for batch, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d"), (3, "e")]]):
        sink.write(spark.createDataFrame(rows, "k long, v string"), batch)
    assert sorted(map(tuple, sink.rows().collect())) == [(1, "a"), (2, "b"), (3, "d")]


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_percentile_of_a_stream_is_one_of_the_values(spark, tmp_path, share):
    """Negative, zero, tiny, huge and equal values; nulls are left out."""
    from evistra.streaming.plans import stream_percentile

    values = [-1e300, -2.5, -2.5, 0.0, 0.0, 1e-300, 3.0, 3.0000001, 3.0000002, 1e9, 1e300, None]
    at = datetime.datetime(2024, 1, 1, 5)
    spark.createDataFrame([(at, v) for v in values], "ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    known = sorted(v for v in values if v is not None)
    want = known[max(1, -int(-len(known) * share // 1)) - 1]
    assert [r.value for r in stream_percentile(spark, str(tmp_path), "day", share).collect()] == [want]

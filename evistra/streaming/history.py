"""A session's history as state: list, map and value state, let go by a timer when the session ends."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds without a turn after which a session is over.
GAP = 1800
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_OUT = "user_id long, event_id long, n_history long, n_errors long, history string"


class Histories(StatefulProcessor):
    """For every turn the history that its session has by then. User ids are not negative.

    State of a user: `turns`, the ids of the session's turns in order; `kinds`, how many there are of each kind; `last`,
    the time of the last one. A turn at least GAP after the last begins a new session, and so does one after the timer,
    which the watermark fires GAP after the last turn and which clears all three: no more is kept than open sessions.
    Turns that come together are put in order of time and id; a turn that comes in a later batch than one after it is
    taken in the order in which it comes, and one later than the watermark is dropped. `history` is a digest of the ids.
    """

    @staticmethod
    def of(events: DataFrame) -> DataFrame:
        # rows without a user, the closing one among them, go after the watermark has seen their time: a filter here would
        # be moved below it; dealt over negative keys, they have no state
        nobody = -1 - F.pmod(F.xxhash64("event_id", "ts"), F.lit(1024))
        turns = events.select(F.coalesce(F.col("user_id").cast("long"), nobody).alias("user_id"), F.col("event_id").cast("long"), F.coalesce("event_type", F.lit("")).alias("kind"), "ts", F.unix_micros("ts").alias("at"))
        return turns.groupBy("user_id").transformWithStateInPandas(Histories(), _OUT, "append", "EventTime")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "event_id long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")
        self.last = handle.getValueState("last", "at long, timer long")

    def _clear(self) -> None:
        self.turns.clear()
        self.kinds.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            yield from (r.iloc[:0].assign(n_history=0, n_errors=0, history="")[["user_id", "event_id", "n_history", "n_errors", "history"]] for r in rows)
            return
        found = pd.concat(rows).sort_values(["at", "event_id"], kind="stable")
        last, timer = self.last.get() or (None, None)
        turns = [t[0] for t in self.turns.get()] if last is not None else []
        kinds = {k[0]: n[0] for k, n in self.kinds.iterator()} if last is not None else {}
        before, fresh, out = len(turns), False, []
        for event, kind, at in zip(found.event_id, found.kind, found["at"]):
            if last is None or at - last >= GAP * 1_000_000:
                turns, kinds, fresh = [], {}, True
            turns.append(event)
            kinds[kind] = kinds.get(kind, 0) + 1
            last = max(at, last or at)
            out.append((key[0], event, len(turns), kinds.get("error", 0), hashlib.md5(",".join(map(str, turns)).encode()).hexdigest()))
        if fresh:
            self._clear()
            before = 0
        self.turns.appendList([(int(t),) for t in turns[before:]])
        for kind, n in kinds.items():
            self.kinds.updateValue((kind,), (int(n),))
        if timer is not None:
            self.handle.deleteTimer(int(timer))
        timer = int(last) // 1000 + GAP * 1000
        self.handle.registerTimer(timer)
        self.last.update((int(last), timer))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "n_history", "n_errors", "history"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def with_histories(spark: SparkSession):
    """Such state needs the provider that keeps it on disk; the session's own choice is put back after the run."""
    was = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if was is None else spark.conf.set(_PROVIDER, was)

"""The eligibility decision list and the ledger it feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKED = ("PROMO",)
#: What a request's reason and an item's condition may be; empty is not given.
REASONS, CONDITIONS = ("quality", "no_reason", ""), ("unopened", "opened", "used", "")
MAX_RISK, MAX_DAYS, GOLD_DAYS, PLAIN_DAYS = 3, 15, 15, 7


def rule_number() -> Column:
    """The first rule that decides a request, 1 to 10; missing and foreign orders are one case."""
    quality = F.col("reason") == "quality"
    window = F.when(quality | F.col("gold"), GOLD_DAYS).otherwise(PLAIN_DAYS)
    rules = [
        F.col("customer_id").isNull(), F.col("refunded"), F.col("refund_count") > MAX_RISK, F.coalesce(F.col("category").isin(*BLOCKED), F.lit(False)),
        F.col("days") > MAX_DAYS, F.col("reason") == "", ~quality & (F.col("condition") == ""), F.col("days") > window, ~quality & (F.col("condition") != "unopened"),
    ]
    out = F.lit(10)
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(r, i).otherwise(out)
    return out


def argument_error(allowed: dict[str, tuple[str, ...]]) -> Column:
    """A message for the first argument outside its list, empty where all are in theirs."""
    wrong = [F.when(~F.coalesce(F.col(c).isin(*names), F.lit(False)), F.concat(F.lit(f"参数错误：{c} "), F.coalesce(F.col(c), F.lit("")))) for c, names in allowed.items()]
    return F.coalesce(*wrong, F.lit(""))


def eligibility(requests: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """requests with rule_no, verdict and refundable. Ownership is part of the join, as a lookup by both keys."""
    own = requests.join(orders, (requests["order_id"] == orders["order_id"]) & (requests["acting_user"] == orders["customer_id"]), "left").drop(orders["order_id"])
    joined = own.join(customers, "customer_id", "left").withColumn("rule_no", rule_number())
    verdict = F.when(F.col("rule_no") == 10, "approve").when(F.col("rule_no").isin(6, 7), "need_info").otherwise("deny")
    refundable = F.when(F.col("rule_no") == 10, F.col("price")).otherwise(F.lit(0.0))
    return joined.select("order_id", "acting_user", "rule_no", verdict.alias("verdict"), refundable.alias("refundable"))


def replay(attempts: DataFrame) -> DataFrame:
    """attempts (session, seq, key, action, ...) with first_seq and replayed: a repeated non-empty key within a
    session returns what its first attempt gave, whatever the action; an empty or null key never replays."""
    key = F.nullif(F.col("key"), F.lit(""))
    w = Window.partitionBy("session", F.coalesce(key, F.concat(F.lit("\0"), F.col("seq").cast("string")))).orderBy("seq")
    return attempts.withColumn("first_seq", F.first("seq").over(w)).withColumn("replayed", F.col("first_seq") != F.col("seq"))


def receipts(attempts: DataFrame, first: int = 9000) -> DataFrame:
    """Applied attempts with their receipt: numbers run on per session in order, from `first`; replays add no row."""
    done = replay(attempts).filter(~F.col("replayed"))
    n = F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1 + first
    letter = F.when(F.col("action") == "approve", "R").otherwise("D")
    return done.withColumn("receipt", F.concat(letter, n.cast("string")))


#: What became of an attempt.
APPLIED, REPLAYED, MISSING, REFUNDED = "applied", "replayed", "missing", "refunded"


def settle(attempts: DataFrame, orders: DataFrame, first: int = 9000) -> DataFrame:
    """(session, seq, action, order_id, status, receipt, amount): each session's attempts in order.

    attempts: session, seq, key, action (approve or deny), order_id, acting_user, amount. orders: order_id, customer_id,
    refunded. An attempt with the key of an applied one gives that one's receipt, whatever its action; an approval of an
    order that is missing, another's or refunded, also by an earlier attempt of the session, is an error that leaves no
    row and doesn't use up its key; a denial needs no order. Receipts run on per session. Empty or null keys never
    replay. Sessions don't see one another's changes. A task reads its sessions row by row and holds one session's keys.
    """
    known = orders.select("order_id", F.col("customer_id").alias("_owner"), F.col("refunded").alias("_refunded"))
    rows = attempts.join(known, "order_id", "left").select("session", "seq", "key", "action", "order_id", "amount", F.coalesce(F.col("_owner") == F.col("acting_user"), F.lit(False)).alias("own"), F.coalesce("_refunded", F.lit(False)).alias("was"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, keys, paid, n = None, {}, set(), first
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.session != session:
                    session, keys, paid, n = r.session, {}, set(), first
                receipt, amount = keys.get(r.key, (None, None)) if r.key else (None, None)
                approve = r.action == "approve"
                status = REPLAYED if receipt else MISSING if approve and not r.own else REFUNDED if approve and (r.was or r.order_id in paid) else APPLIED
                if status == APPLIED:
                    receipt, amount, n = f"{'R' if approve else 'D'}{n}", r.amount if approve else 0.0, n + 1
                    if r.key:
                        keys[r.key] = receipt, amount
                    if approve:
                        paid.add(r.order_id)
                out.append((status, receipt, amount))
            done = pd.DataFrame(out, columns=["status", "receipt", "amount"], index=frame.index)
            yield pd.concat([frame[["session", "seq", "action", "order_id"]], done], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("session", "seq", "action", "order_id")) + ", status string, receipt string, amount double"
    return rows.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, schema)

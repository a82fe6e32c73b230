"""Exact statistics that gather no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def nearest_rank(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """One row a key with, for each name, the value at index min(floor(n * share), n - 1) of the key's sorted values.

    The values are counted in BUCKETS equal parts of the key's range; only the part that holds an index is sorted.
    Null keys and values are left out.
    """
    v = df.select(key, F.col(value).cast("double").alias("_v")).filter(F.col(key).isNotNull() & F.col("_v").isNotNull())
    range_ = v.groupBy(key).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    part = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BUCKETS))).otherwise(F.lit(0)).cast("int")
    placed = v.join(F.broadcast(range_), key).withColumn("_part", part)
    counts = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_k"), F.max("_n").alias("_n"))
    upto = counts.withColumn("_before", F.sum("_k").over(Window.partitionBy(key).orderBy("_part")) - F.col("_k"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("_n") * p), F.col("_n") - 1).alias("at")) for name, p in shares.items())))
    hit = upto.select(key, "_part", "_before", "_k", wanted.alias("w")).filter((F.col("w.at") >= F.col("_before")) & (F.col("w.at") < F.col("_before") + F.col("_k")))
    few = placed.select(key, "_part", "_v").join(F.broadcast(hit.select(key, "_part").distinct()), [key, "_part"])
    ranked = few.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_part").orderBy("_v")) - 1)
    found = hit.join(ranked, [key, "_part"]).filter(F.col("_i") + F.col("_before") == F.col("w.at"))
    return found.groupBy(key).agg(*(F.max(F.when(F.col("w.name") == name, F.col("_v"))).alias(name) for name in shares))

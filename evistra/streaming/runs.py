"""Running a stream to the end of what there is, windows closed."""

from __future__ import annotations

from contextlib import AbstractContextManager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evistra.sources.shared import folder

#: The time of the row that closes a stream; rows are before it. Later times don't fit pandas' nanoseconds.
CLOSING = "2200-01-01 00:00:00"


class Feed:
    """A table as a stream, followed by a closing row once close() is called.

    A stream takes a folder or a pattern, so the table is named by a pattern: it may be one file or a folder of files.
    NTZ times become timestamps, which watermarks need. The closing row is null but for its time.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, files: int | None = None):
        self.spark, self.where = spark, folder(spark, "closing")
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        read = spark.readStream.schema(schema)
        rows = (read.option("maxFilesPerTrigger", files) if files else read).parquet(f"{sf_dir}/{name}.parque[t]")
        timed = "ts" in schema.names
        self.rows = rows.withColumn("ts", F.col("ts").cast("timestamp")) if timed else rows
        self.closing = spark.range(1).select(*(F.lit(CLOSING if c.name == "ts" else None).cast(c.dataType).alias(c.name) for c in self.rows.schema)) if timed else None
        if timed:
            self.closing.limit(0).write.parquet(self.where)
            self.rows = self.rows.unionByName(spark.readStream.schema(self.rows.schema).parquet(self.where))

    def close(self) -> None:
        self.closing.write.mode("append").parquet(self.where)


def stream_of(spark: SparkSession, sf_dir: str, name: str, watermark: str | None = None, files: int | None = None) -> DataFrame:
    """A table as a stream, with a watermark on ts; drained() closes it. `files` is how many a batch reads, else all.

    With several batches, rows that come later than the watermark are dropped from windows; dropped() counts them.
    """
    feed = Feed(spark, sf_dir, name, files)
    rows = feed.rows.withWatermark("ts", watermark) if watermark else feed.rows.filter(f"ts is null or ts < timestamp'{CLOSING}'") if feed.closing is not None else feed.rows
    rows._feed = feed
    return rows


def drained(source: DataFrame, df: DataFrame, manage: AbstractContextManager | None = None, progress: list | None = None) -> DataFrame:
    """The rows that df, made from `source`, gives for all that is there, kept as Parquet in the shared folder.

    Append mode: a window's row comes once. After the data a closing row takes the watermark past every window; that
    row's own window stays open and never comes. `progress` takes the batches' progress; `manage` surrounds the run.
    """
    spark, where, feed = df.sparkSession, folder(df.sparkSession, "stream"), getattr(source, "_feed", None)
    with (manage(spark) if manage else nullcontext()):
        for last in (False, True) if feed is not None and feed.closing is not None else (True,):
            if last and feed is not None and feed.closing is not None:
                feed.close()
            run = df.writeStream.option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).format("parquet").option("path", f"{where}/rows").start()
            run.awaitTermination()
            if progress is not None:
                progress += run.recentProgress
    return spark.read.schema(df.schema).parquet(f"{where}/rows")


def _state(progress: list, name: str) -> list[int]:
    return [sum(s[name] for s in p["stateOperators"]) for p in progress if p["stateOperators"]]


def dropped(progress: list) -> int:
    """Rows that came later than the watermark and are in no window."""
    return sum(_state(progress, "numRowsDroppedByWatermark"))


def held(progress: list) -> list[int]:
    """Rows of state after each batch."""
    return _state(progress, "numRowsTotal")

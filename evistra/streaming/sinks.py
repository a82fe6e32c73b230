"""A sink that a replayed batch doesn't change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evistra.sources.shared import folder


class CommittedSink:
    """Rows of batches under the shared folder, each batch committed with its number.

    A batch is written to a folder of its own and then committed by a row that names it. Spark runs a batch again after a
    failure: one that was written but not committed is written anew in its place, and one that was committed is left
    as it is. Readers see committed batches only, so every row counts once. With keys, the first batch's row of a key
    is the one that counts, whatever later batches bring.
    """

    def __init__(self, spark: SparkSession, schema: StructType, keys: list[str] | None = None, where: str | None = None):
        self.spark, self.schema, self.keys, self.where = spark, schema, keys or [], where or folder(spark, "sink")
        self._commits = "batch long, n long"
        spark.createDataFrame([], self._commits).write.mode("append").parquet(f"{self.where}/commits")

    def commits(self) -> DataFrame:
        """(batch, n): the batches that count, and their rows."""
        return self.spark.read.schema(self._commits).parquet(f"{self.where}/commits").distinct()

    def write(self, rows: DataFrame, batch: int, before_commit: Callable[[], None] = lambda: None) -> None:
        if self.commits().filter(F.col("batch") == batch).count():
            return
        to = f"{self.where}/rows/batch={batch}"
        rows.write.mode("overwrite").parquet(to)
        before_commit()
        n = self.spark.read.schema(self.schema).parquet(to).count()
        self.spark.createDataFrame([(batch, n)], self._commits).coalesce(1).write.mode("append").parquet(f"{self.where}/commits")

    def run(self, rows: DataFrame, before_commit: Callable[[], None] = lambda: None) -> None:
        """Take what a stream gives until nothing is left."""
        out = rows.writeStream.option("checkpointLocation", f"{self.where}/state").trigger(availableNow=True)
        out.foreachBatch(lambda df, batch: self.write(df, batch, before_commit)).start().awaitTermination()

    def rows(self) -> DataFrame:
        done = [r["batch"] for r in self.commits().select("batch").collect()]  # a number for each batch
        if not done:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(StructType([*self.schema.fields]).add("batch", "long")).option("basePath", f"{self.where}/rows")
        rows = read.parquet(*(f"{self.where}/rows/batch={b}" for b in done))
        if self.keys:
            first = Window.partitionBy(*self.keys).orderBy("batch", *(c for c in self.schema.names if c not in self.keys))
            rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        return rows.drop("batch")

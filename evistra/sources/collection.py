"""A collection of chunks kept by layer and year, so that a dated search opens few of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file at most: small enough that the dates it spans tell files apart.
FILE_ROWS = 200_000


def write(chunks: DataFrame, where: str, file_rows: int = FILE_ROWS) -> None:
    """Keep chunks (layer, effective_date, expire_date as ISO text, ...) in folders by layer and the year they begin in.

    Within a folder rows lie in order of their dates, so that a file's least and greatest ones tell whether to open it.
    A null layer or date has a folder of its own.
    """
    year = F.coalesce(F.left("effective_date", F.lit(4)), F.lit("none"))
    dealt = chunks.withColumn("from_year", year).repartitionByRange("layer", "from_year", "effective_date", "expire_date").sortWithinPartitions("layer", "from_year", "effective_date", "expire_date")
    dealt.write.option("maxRecordsPerFile", file_rows).mode("overwrite").partitionBy("layer", "from_year").parquet(where)


def read(spark: SparkSession, where: str, layers: list[str] | None = None, day: str | None = None) -> DataFrame:
    """Chunks of some layers in force on a day: folders of other layers and of later years aren't listed among the files,
    and files whose dates are all too late or too early are skipped by their statistics."""
    rows = spark.read.option("basePath", where).parquet(where)
    known: list[Column] = []
    if layers is not None:
        known.append(F.col("layer").isin(layers))
    if day is not None:
        known += [F.col("from_year").cast("string") <= day[:4], F.col("effective_date") <= day, F.col("expire_date") > day]
    for condition in known:
        rows = rows.filter(condition)
    return rows.drop("from_year")

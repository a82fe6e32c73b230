"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which a session on a cluster has to name.

    A local session, whose executor is the driver, gets a folder of its own where it is unset.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evistra-"))
        base = sc.getCheckpointDir()
    return base


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/evistra/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts the lineage, survives lost executors.

    With `by`, a folder for each value of that column, so that a filter on it reads no others.
    """
    path = folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Shared storage of a job: lineage is cut with tables in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; or, where that is unset and driver and executors are one process, as in tests, a folder of our own.
    On a cluster there is no folder that all see unless it is named: an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="weftlink-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: later steps survive lost executors, and nothing is computed twice."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder of a run's own in the shared one, for tables that are only read until it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.folder}/{tag}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the tables; plans that read them are of no use any more."""
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems can reach it; it may be gone already."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that results depend on. A union of equally partitioned inputs
    must not pass for partitioned itself: adaptive execution may have merged
    their partitions differently."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def folder(spark: SparkSession) -> str:
    """A new folder (a URI) under ``spark.checkpoint.dir``. Where that is unset,
    as in tests, a local one, which only a local master may use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        base = "file://" + os.path.join(tempfile.gettempdir(), "sievelake-work")
    return f"{base.rstrip('/')}/sievelake-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: this cuts the
    lineage and survives the loss of executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

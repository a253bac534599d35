"""Shared folder for intermediate and streamed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Without that setting
    the executors of a cluster would each write to a folder of their own: an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/pagemill-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and lost executors lose nothing."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)

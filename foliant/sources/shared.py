"""The folder that driver and executors share, and tables that are kept there on the way to a result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only on one machine a local one is made where the session names none."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="foliant-")
    return f"{top.rstrip('/')}/stream-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df` written once and read back: its lineage is the file's, so a lost executor costs one read."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

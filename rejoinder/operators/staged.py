"""Tables that a job writes for itself: the lineage ends there, they are read as often as needed and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir, which driver and executors share.

    A local session without one takes /tmp/checkpoints; any other session raises, since its executors share no disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share (file:///tmp/checkpoints serves local sessions only)")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

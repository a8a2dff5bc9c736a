"""Tables written once in the folder that driver and executors share, where their lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; only a local session, whose one machine shares all, may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in that folder, read again: what is used several times is computed once, and a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

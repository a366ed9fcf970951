"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where spark.checkpoint.dir is unset; on one machine only.
LOCAL = "file:///tmp/checkpoints"
#: Rows up to which a narrow table is broadcast (a few tens of bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def shared_path(spark: SparkSession, name: str) -> str:
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows. Reads df once to count: pass a saved table
    or one that is cheap to make."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df

"""Reductions and element-wise kernels over number columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot(df: DataFrame, a: str, b: str) -> DataFrame:
    """Sum of a * b, summed in decimals of two places, so that it doesn't depend on the order."""
    return df.agg(F.sum((F.col(a) * F.col(b)).cast("decimal(18,2)")).cast("double").alias("dot"))


def added(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("c", F.col(a) + F.col(b))


def added_and_multiplied(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("c", F.col(a) + F.col(b)).withColumn("d", F.col(a) * F.col(b))


def extremes(df: DataFrame, by: str, value: str) -> DataFrame:
    """Best, mean and worst of a measurement by group."""
    return df.groupBy(by).agg(F.max(value).alias("best"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("worst"))

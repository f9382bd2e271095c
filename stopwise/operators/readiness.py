"""Row counts and the gate in front of training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("record_count"))


def is_ready(df: DataFrame, threshold: int = 100) -> bool:
    """Whether at least ``threshold`` records exist.

    A few splits are tried first and more only while rows are missing.
    """
    return len(df.select(F.lit(1)).take(threshold)) >= threshold


def readiness(df: DataFrame, threshold: int = 100) -> DataFrame:
    """One row: whether at least ``threshold`` records exist."""
    ready = is_ready(df, threshold)
    return df.sparkSession.range(1).select(F.lit(ready).alias("ready"))

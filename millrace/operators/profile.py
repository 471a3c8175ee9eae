"""Profiling before modelling: each is one aggregation over one narrow scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """``duplicates``: rows beyond the first of each key, exactly."""
    return df.agg((F.count("*") - F.count_distinct(key)).cast("bigint").alias("duplicates"))


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """``value, n``, most frequent first."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_last())


def nulls(df: DataFrame, col: str) -> DataFrame:
    """``nulls`` and ``n`` of all rows."""
    return df.agg(F.count_if(F.col(col).isNull()).cast("bigint").alias("nulls"), F.count("*").alias("n"))


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    """``rows_per_key, keys``: how many keys have so many rows."""
    each = df.groupBy(key).agg(F.count("*").alias("rows_per_key"))
    return each.groupBy("rows_per_key").agg(F.count("*").alias("keys")).orderBy("rows_per_key")

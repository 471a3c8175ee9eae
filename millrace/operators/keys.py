"""Surrogate keys without gaps, in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Up to this size, as the planner estimates it, one task numbers all rows.
ONE_TASK_BYTES = 32 << 20


def size_of(df: DataFrame) -> int:
    """The planner's estimate in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def surrogate_keys(df: DataFrame, order_by: list[str], key: str, offset: Column | int = 0, one_task_bytes: int = ONE_TASK_BYTES) -> DataFrame:
    """``df`` with ``key``: offset + 1, offset + 2, ... in the order of the columns (which should be unique and not null).

    A small input is numbered by one window. A large one is cut into ranges, whose bounds
    (a row for each shuffle partition) come to the driver; each range is numbered on its
    own, from the sum of the counts before it.
    """
    start = offset if isinstance(offset, Column) else F.lit(offset)
    if size_of(df) <= one_task_bytes:
        return df.withColumn(key, (start + F.row_number().over(Window.orderBy(*order_by))).cast("bigint"))
    place = F.struct(*order_by)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.select(*order_by).repartitionByRange(n, *order_by).groupBy(F.spark_partition_id().alias("p")).agg(F.min(place).alias("lo"))
    bounds = [F.struct(*[F.lit(r["lo"][c]).cast(df.schema[c].dataType).alias(c) for c in order_by]) for r in ranges.orderBy("lo").collect()]

    def bucket(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(place >= bounds[mid], bucket(mid, hi)).otherwise(bucket(lo, mid))

    placed = df.withColumn("__range", bucket(0, len(bounds)))
    counts = {r["__range"]: r["count"] for r in placed.groupBy("__range").count().collect()}
    before, total = {}, 0
    for b in range(len(bounds)):
        before[b] = total
        total += counts.get(b, 0)
    offsets = F.element_at(F.array(*[F.lit(before[b]) for b in range(len(bounds))]), F.col("__range") + 1)
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order_by))
    return placed.withColumn(key, (start + offsets + within).cast("bigint")).drop("__range")

"""Snapshots that arrive as a stream of files, merged load by load into a versioned dimension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators.scd import merge_type2
from millrace.sources.files import write_table


def merge_stream(spark: SparkSession, folder: str, schema: StructType | str, dim_path: Callable[[int], str], empty: DataFrame, checkpoint: str) -> StreamingQuery:
    """Watch a folder of Parquet snapshots with ``load_date``; each micro-batch's loads are merged in order of date.

    Version n of the dimension is written to ``dim_path(n)``, n being the batch's number, so
    a batch that is run again after a failure writes the same result to the same place.
    """

    def merge(batch: DataFrame, number: int) -> None:
        dim = spark.read.schema(empty.schema).parquet(dim_path(number - 1)) if number else empty
        batch.persist()
        try:
            for load in sorted(r[0] for r in batch.select("load_date").distinct().collect()):
                dim = merge_type2(dim, batch.where(batch["load_date"] == load).drop("load_date"), str(load))
            write_table(dim, dim_path(number))
        finally:
            batch.unpersist()

    source = spark.readStream.schema(schema).parquet(folder)
    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

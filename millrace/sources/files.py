"""Readers and writers. Schemas are declared: inference costs a pass and guesses."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class MissingTableError(Exception):
    """A table that a read-only consumer needs isn't there."""


def land_csv(spark: SparkSession, path: str, schema: StructType | str, view: str | None = None) -> DataFrame:
    """A CSV file with a header, replaced in full wherever it is landed; registered as ``view`` if given."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def numbered(df: DataFrame, name: str = "__ord") -> DataFrame:
    """With an ordinal that follows the order of the files; for use straight after a scan."""
    return df.withColumn(name, F.monotonically_increasing_id())


def snapshots(loads: list[tuple[str, DataFrame]]) -> DataFrame:
    """Full extracts as one frame with ``load_date``; dates must rise strictly."""
    dates = [d for d, _ in loads]
    if dates != sorted(set(dates)):
        raise ValueError(f"load dates must rise strictly: {dates}")
    out = None
    for d, df in loads:
        own = df.withColumn("load_date", F.lit(d).cast("date"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no snapshots")
    return out


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Create or replace as Parquet; never over a path that ``df`` reads."""
    place = PurePosixPath(unquote(urlparse(path).path))
    if any(PurePosixPath(unquote(urlparse(f).path)).is_relative_to(place) for f in df.inputFiles()):
        raise ValueError(f"{path} is being read")
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or where that is unset on a single machine, below the temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A table for reading; ``MissingTableError`` if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise MissingTableError(f"no table at {path}: build the warehouse first") from e


def write_report(report: DataFrame, path: str) -> str:
    """A small report as one CSV file; arrays as JSON, white space kept."""
    arrays = {c: F.to_json(c) for c, kind in report.dtypes if kind.startswith(("array", "struct", "map"))}
    report.withColumns(arrays).coalesce(1).write.mode("overwrite").csv(path, header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def as_text(df: DataFrame, rows: int = 50) -> str:
    """The first rows as an aligned table."""
    return df.limit(rows).toPandas().to_string(index=False)

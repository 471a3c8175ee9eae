"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import shared_folder

#: Arrow batches stay this small, so that a Python worker's memory doesn't follow the length of the texts.
BATCH_ROWS = 2_000
BATCH_BYTES = "4m"
#: Bytes of input for each block or bucket that an operator cuts its work into.
BLOCK_INPUT = 8 << 20
#: Keys that ``spread_join`` treats apart, at most.
HEAVY_KEYS = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of that name, read by Spark from wherever ``sf_dir`` is."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and in bytes (unless the session sets its own bytes)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") in ("-1", "67108864", "2147483647", "9223372036854775807"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back_memory()

    return df.mapInArrow(run, schema)


def give_back_memory() -> None:
    """Return what a task has freed to the system: workers are kept for later stages, and what they hold adds up beside the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """The same for the executors' heaps, by a full collection in each task slot: of hundreds of MB that one stage made a heap grow by, little is alive at its end, but a large heap puts off the collection that would shrink it."""
    slots = spark.sparkContext.defaultParallelism
    collected = F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, slots, 1, slots).select(collected).write.format("noop").mode("overwrite").save()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Where the tables that ``stored`` has written lie.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    It cuts the lineage, survives a lost executor, and gives the planner true sizes. The
    folder goes when the driver's Python ends in the usual way, or earlier by ``forget``.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read any more."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path:
            _remove(table.sparkSession, path)


def with_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``__row``, a number that names a row in every job that reads it.

    It is the id where all rows have different ids. Otherwise the rows are numbered once and
    stored: numbers given anew by each job would follow how that job splits the files.
    """
    own = F.col(id_col).cast("long")
    again = docs.select(own.alias("i")).groupBy("i").agg(F.count("*").alias("rows")).where("i is null or rows > 1")
    if again.limit(1).count():
        return stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    return docs.withColumn("__row", own)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str = "size", total: int | None = None) -> DataFrame:
    """``rows.join(table, keys)`` for a stored ``table`` of one row a key that says how many ``rows`` have it.

    Keys with more than a quarter of a partition's fair share (and more than one in
    ``HEAVY_KEYS`` of all rows, so that there are fewer of them than that) meet their rows on the map side, told by
    a hash of theirs; only the others are shuffled. ``total`` is the sum of the sizes, where it is known.
    """
    if total is None:
        total = table.agg(F.sum(size)).first()[0] or 0
    share = max(total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), total // HEAVY_KEYS)
    place = F.xxhash64(*keys)
    heavy = [r["h"] for r in table.where(F.col(size) > share).select(place.alias("h")).collect()] if share else []
    if not heavy:
        return rows.join(table.drop(size), keys)
    few = F.broadcast(table.where(place.isin(heavy)).drop(size))
    return rows.where(place.isin(heavy)).join(few, keys).unionByName(rows.where(~place.isin(heavy)).join(table.where(~place.isin(heavy)).drop(size), keys))


def n_blocks(docs: DataFrame) -> int:
    """Blocks in proportion to the input's size, as the planner knows it."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // BLOCK_INPUT)) if size < 1 << 50 else least

"""From raw documents to training tokens, in five stages.

Each stage takes what the stage before it kept, written as Parquet and read again, and
returns it with its own decisions carried out. All but the last return the columns of
``documents``. Null and empty texts go in the first stage; rows without an id, repeated rows and rows of
equal ids are told apart by their number, and each is judged by itself; extra columns stay up to
the last stage; an empty table stays one. Each stage begins with the executors' heaps given back, so
that memory doesn't add up from stage to stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontamination, ngram_join, pii, quality
from millrace.llm.common import give_back_heaps, load, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is out of bounds, and empty ones, go."""
    give_back_heaps(spark)
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that are linked, directly or over others, the one of the smallest id stays."""
    give_back_heaps(spark)
    return ngram_join.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that a benchmark item is copied in go."""
    give_back_heaps(spark)
    return decontamination.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    give_back_heaps(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids and their number."""
    give_back_heaps(spark)
    import public_tokenizers

    ids = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("byte-level BPE", bpe_stage),
]

#: The first stage's model can't be put in SQL: tests/llm/test_pipeline.py holds run()'s rows, ids and token ids, against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs

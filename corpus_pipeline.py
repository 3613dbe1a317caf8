"""The corpus pipeline: quality rules, near duplicates, repeated passages, decontamination, mix.

Each stage takes what its predecessor kept, as a table; all but the last return
the columns of ``documents``. ``run`` writes every stage to the shared
checkpoint folder and reads it again, so a lost executor never reaches back
beyond one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from areascope.llm import decontaminate, jaccard_join, mixing, quality_rules, suffix_dedup
from areascope.llm.common import release, table, written


#: Bytes from which a repeated passage goes: 50 words of the usual six bytes are over 300.
PASSAGE = 240


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python 512 rows at a time: Spark's 10,000 would hold tens of MB in every task, on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail them."""
    _small_batches(spark)
    return quality_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    _small_batches(spark)
    return jaccard_join.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of PASSAGE bytes that also start elsewhere; those with no word left go."""
    _small_batches(spark)
    return suffix_dedup.clean_documents(docs, length=PASSAGE, gram=64)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows cover less than a twentieth of the words."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each document in the mix."""
    return mixing.mix(docs, mixing.word_size())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
]

#: The mix draws at random (with a fixed seed) and the suffix stage works on bytes: tests hold both against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return docs

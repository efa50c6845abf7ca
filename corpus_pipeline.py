"""A training-corpus pipeline of five stages; each stage works on the table that the one before has written.

All stages take empty tables, repeated rows and ids, and further columns, which come out unchanged (the last stage has its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import bpe, decontaminate, exact_dedup, near_join, quality, store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A row is judged by its own text, whatever its id; null and empty texts get the score of the bias, very long ones are read whole,
    and without labels nothing is rejected.
    """
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, null ids last; null counts as empty, and of rows that repeat id and text one stays."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, null ids last; texts without words all stay."""
    return near_join.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go, each judged by its own text; an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what remains, a row each; null and empty texts have no tokens."""
    return bpe.digests(docs, bpe.public_model())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The classifier's training and BPE merges can't be put in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result but the last is written to the shared folder and read again."""
    docs = store.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

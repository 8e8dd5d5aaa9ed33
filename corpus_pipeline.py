"""From raw documents to training ids: five stages, each of which works on all that the one before it kept.

Every stage is written as Parquet and read again by the next. Stages 1 to 4 return the columns of documents; the last
returns token counts and digests. SQL cannot express the language models of the first stage, so there is no SQL for
the whole; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodewell.llm import bpe, langid, line_dedup, minhash, mixing
from lodewell.llm.common import bounded_batches, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a language that is hard to tell keeps its document."""
    bounded_batches(spark)
    return langid.drop_unidentified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters that five documents hold stay in the one of the largest id."""
    bounded_batches(spark)
    return line_dedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 over five-word shingles, the document of the smallest id stays."""
    bounded_batches(spark)
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as their source's target takes them."""
    bounded_batches(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts with digests of ids and of the decoded text."""
    bounded_batches(spark)
    return bpe.encode(docs, digest=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", near_dedup),
    ("mixing", mix),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Documents to training tokens: quality, near duplicates, secrets, source weights, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonagrid.llm import bpe, kneser_ney, minhash, mixing, secrets
from sonagrid.llm.common import step, table
from sonagrid.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model, trained on trusted ones, doesn't reject."""
    return kneser_ney.filtered(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights ask for."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text and what they decode to, as digests."""
    return bpe.encode_documents(docs, VOCABULARY)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mixing", mixture), ("encoding", encoding)]

#: The first two stages are iterative or statistical, which SQL doesn't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each reads what the one before it wrote.

    What a stage stored on its way is deleted once its result is written. Nulls, empty and long texts, repeated rows and
    clashing column names fare in each stage as its operator says; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = step(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

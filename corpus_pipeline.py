"""A corpus from `documents`: language, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with docs' columns; the last returns the encoded corpus. Every
stage is written as Parquet in shared storage and read again for the next. Stages treat rows as their operators'
docstrings say: nulls, empty tables and columns of any name pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common, decontaminate, exact_dedup, jaccard_join, language_id, piece_codec


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and texts without a letter go."""
    return language_id.accepted(docs, language_id.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, 5, 80, 100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with digests of the ids, their byte spans and the decoded text."""
    return piece_codec.tokenised(docs)


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("token_ids", token_ids)]

#: SQL can't express the trained and signature-based stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = common.table(spark, sf_dir, "documents"), common.shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"{ws}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus preparation in five stages over `documents`.

Each stage takes (spark, docs, sf_dir), where docs is the written result of the stage before, and returns a
DataFrame. All but the last return the columns of `documents`, whatever further ones there are. Every stage judges
rows by their own whole texts, also those whose doc_id is null or repeated, and gives an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tapeworks.llm import decontaminate, language, packing, secret_scan, simhash
from tapeworks.llm.common import shared_dir
from tapeworks.llm.tokens import public_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty ones too) or without a clear language go; the model learns from the labelled ones."""
    return language.keep_known(docs, language.fit(docs.where(~language.held_out())))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays (and rows without one, which can't be named)."""
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, null and empty texts as they are."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document row with their sequences; null and empty texts are the end id alone."""
    return packing.pack_documents(docs, public_path())


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: XXH64 fingerprints, inferred automata and tokenization have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/tapeworks/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The training-data pipeline: each stage reads what the one before wrote.

Every stage but the last returns the columns of its documents, whatever they are. Null ids stay: language ID and toxicity judge texts alone, near-dedup
compares no row without an id. A null text goes in the first stage; in the others it is a text without a word, which is clean, a copy of
nothing and holds no secret. Equal rows fare alike until near-dedup, which keeps one of them. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import best_fit_packing, language_id, secret_scan, toxicity, weighted_dedup
from treeloom.llm.common import scratch, staged


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; null texts, texts without a letter and long ones that parse no better than strange letters go. A null lang is filled in."""
    return language_id.keep_known(docs, language_id.samples(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(toxicity.examples(docs, labels)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id."""
    return weighted_dedup.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return best_fit_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [("language_id", languages), ("toxicity", toxic), ("minhash_near_dedup", near_duplicates), ("secret_scan", secrets), ("best_fit_packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch() as tables:  # a stage's own tables go with it, and so does its input
            docs = staged(stage(spark, docs, sf_dir), name)
            tables.remove(docs)
            tables.extend([before] if before is not None else [])
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: classify, apply certified rules, drop near-duplicates, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``, whatever these are called, with their rows' own values.

Defined cases, each stage by its operator's: nulls and empty or blank texts have features and a score, and what the classifier keeps of
them fails the base rule, which asks for 50 words; equal rows are one group of near-duplicates, of which one row stays; a null source
is a source of its own; a null doc_id is no reason to drop a row; empty tables pass through all stages as empty tables.

A stage's intermediate tables and the table of the stage before are deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from docmill.llm import common, gam, hof_bpe, mixing, quality_rules, weighted_minhash


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model predicts to be of quality (operator 3)."""
    return gam.apply(docs, _labels(spark, sf_dir))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the certified cutoffs (operator 7)."""
    return quality_rules.apply(docs, _labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (operator 6)."""
    return weighted_minhash.apply(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it (operator 2)."""
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, as counts and digests (operator 9)."""
    return hof_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("classify", classify), ("rules", rules), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: The classifier and the near-duplicate stage aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = common.fresh_path(spark, f"pipeline-{name}")
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        common.remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)

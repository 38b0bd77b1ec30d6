"""The corpus pipeline: quality rules, line dedup, n-gram join, secret scan, packing, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import line_dedup, ngram_join, packing, quality_rules, secrets
from pulsegrid.llm.common import documents, materialize


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_documents(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others keep."""
    return line_dedup.dedup_documents(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar n-gram sets the one with the smallest id."""
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    return secrets.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: The learned secret model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline over ``documents``: STAGES in order, each written as Parquet and read again.

1. quality rules: documents that the base rules or the outlier test reject go;
2. n-gram Jaccard join: of each group of near duplicates the smallest document stays;
3. benchmark decontamination: documents with a benchmark passage go;
4. secret scans: documents with secrets go;
5. mixing: documents are read for 0.6 of the remaining tokens, by domain, language and source.

All but the last return the columns of their input. A stage judges all rows its predecessor
kept. ``sf_dir`` is read for ``benchmark`` only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlens.llm import decontamination, jaccard_orders, mixing, outliers, queries, secret_battery
from wardlens.llm.tables import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return outliers.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_orders.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without secrets."""
    return secret_battery.drop_leaky(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to read, with how often each is read."""
    return mixing.mix(docs, queries.source_domain(), queries.MIX_WEIGHTS, queries.MIX_SHARE)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("secret_scans", secrets),
    ("source_mixing", mix),
]

# The outlier test and the randomness battery have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A table of releases in which one release can be replaced while others are read.

``data/write=<id>/period=<label>/`` holds the rows of one write; ``manifest/`` is a small table with
one row per write and release, added to but never changed. The newest row of a release names the
write that holds it. A write becomes visible with the one manifest file it appends at its end, so a
broken write is never seen, and readers of other releases are not disturbed. Replaced rows stay on
disk until their owner clears them. One writer at a time; readers need not wait.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_ENTRY = StructType([StructField("version", LongType()), StructField("period", StringType()), StructField("write", StringType())])


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_ENTRY).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ENTRY)


def _live(spark: SparkSession, path: str) -> DataFrame:
    """The write that holds each release now, one row per release."""
    return _manifest(spark, path).groupBy("period").agg(F.max_by("write", "version").alias("write"))


def _typed(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a folder of writes, columns by name, both folder columns as text."""
    found = spark.read.option("mergeSchema", "true").parquet(path).schema
    folders = ("write", "period")
    return spark.read.schema(
        StructType([StructField(f.name, StringType()) if f.name in folders else f for f in found.fields])
    ).parquet(path)


def write_releases(df: DataFrame, path: str) -> None:
    """Store the releases in ``df``, each in place of the release of the same label, if there is one.

    ``df`` has a text column ``period``; a row without label is an error and leaves the table as it was.
    Releases that are not in ``df`` stay as they are. No rows, no change.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    folder = f"{path}/data/write={name}"
    # Checked as the rows are written: an unlabelled row fails the write before the manifest knows of it.
    label = F.coalesce(F.nullif("period", F.lit("")), F.raise_error(F.lit("a row has no release label")).cast("string"))
    df.withColumn("period", label).hint("rebalance", "period").write.partitionBy("period").parquet(folder)
    try:
        labels = _typed(spark, folder).select("period").distinct()
    except AnalysisException as empty:
        if empty.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return
    version = _manifest(spark, path).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    entry = labels.select(F.lit(version).cast("long").alias("version"), "period", F.lit(name).alias("write"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # one file: all its releases appear at once


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Every release as last written; a filter on ``period`` prunes folders."""
    live = _live(spark, path)
    writes = [r["write"] for r in live.select("write").distinct().collect()]  # at most one per release
    if not writes:
        raise FileNotFoundError(f"no releases in {path}")
    rows = _typed(spark, f"{path}/data").filter(F.col("write").isin(writes))
    return rows.join(F.broadcast(live), ["write", "period"], "left_semi").drop("write")  # one row per release

"""Result writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Replace the table at ``path``; CSV gets a heading line.

    Rows of a partitioned table are brought together by partition first, so that there are few files
    per partition; adaptive execution splits the large ones.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Nested metrics as JSON, one document per row; undefined values are kept as null."""
    metrics.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Preparation and model stages together, so scoring needs nothing else."""
    model.write().overwrite().save(path)

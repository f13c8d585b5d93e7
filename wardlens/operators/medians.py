"""Exact medians of several columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.operators.ranking import running_total


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n, median) over the non-null values; an even count takes the middle pair's mean.

    Values shrink to counts per distinct value first, and the middle is found by adding
    up counts in value order, so neither a buffer of all values nor a sort of all rows is needed.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    counts = (
        df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).groupBy("column_name", "v").agg(F.count("*").alias("_n"))
    )
    placed = running_total(counts, [("column_name", "asc"), ("v", "asc")], "_n", "_before")
    # One row per column name, so the broadcast is as small as the column list.
    spans = placed.groupBy("column_name").agg(F.min("_before").alias("_start"), F.sum("_n").alias("n"))
    located = placed.join(F.broadcast(spans), "column_name").withColumn("_low", F.col("_before") - F.col("_start"))

    def at(position: str) -> Column:
        here = F.expr(position)
        return F.max(F.when((F.col("_low") < here) & (here <= F.col("_low") + F.col("_n")), F.col("v")))

    middle = located.groupBy("column_name", "n").agg(at("(n + 1) div 2").alias("_a"), at("n div 2 + 1").alias("_b"))
    return middle.select("column_name", "n", ((F.col("_a") + F.col("_b")) / 2).alias("median"))

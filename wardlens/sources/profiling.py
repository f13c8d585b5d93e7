"""Quick looks at a table: lengths, counts, coverage, balance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.rounding import half_even


def _tall(df: DataFrame, per_column: dict[str, Column], value: str) -> DataFrame:
    """One aggregate per column in a single pass, turned to (position, column_name, value)."""
    names = list(per_column)
    one_row = df.agg(*[v.alias(f"_{i}") for i, v in enumerate(per_column.values())])
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("column_name"), F.col(f"_{i}").alias(value))
            for i, n in enumerate(names)
        ]
    )
    return one_row.select(F.inline(rows))


def max_lengths(df: DataFrame) -> DataFrame:
    """Longest text per column; 0 when a column is empty."""
    lengths = {c: F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)) for c in df.columns}
    return _tall(df, lengths, "max_length")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def distinct_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns in one pass, as (column_name, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).distinct().orderBy("column_name", "value")


def coverage(df: DataFrame) -> DataFrame:
    """Share of non-null values per column, in percent with one decimal."""
    shares = {c: half_even(F.avg(F.col(f"`{c}`").isNotNull().cast("double")) * 100, 1) for c in df.columns}
    return _tall(df, shares, "coverage_pct").drop("position")


def balance(df: DataFrame, column: str) -> DataFrame:
    """Share of rows per value, three decimals; NULL is left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select(column, half_even(F.col("_n").cast("double") / total, 3).alias("share")).orderBy(
        F.desc("share"), column
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, hospitals, releases, and whether any release is made-up demo history (``SIM-``)."""
    simulated = F.coalesce(F.bool_or(F.col("period").startswith("SIM-")), F.lit(False))
    return panel.agg(
        F.count("*").alias("row_count"),
        F.countDistinct("facility_id").alias("hospitals"),
        F.countDistinct("period").alias("periods"),
        simulated.cast("int").alias("has_simulated"),
    )

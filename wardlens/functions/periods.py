"""Dates and release labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIOD_PATTERN = r"(\d{4}-\d{2}-\d{2})"


def parse_date(c: Column | str) -> Column:
    """Text date to DATE, month-first as published or ISO; bad text is NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_date(c, "MM/dd/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def period_of(name: Column | str) -> Column:
    """Release label in a file name: its first ISO date, else the bare file stem."""
    name = F.col(name) if isinstance(name, str) else name
    base = F.element_at(F.split(name, "/"), -1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    dated = F.regexp_extract(name, PERIOD_PATTERN, 1)
    return F.when(dated != "", dated).otherwise(stem)


def release_labels(df: DataFrame, period: str = "period") -> Column:
    """Sorted array of the distinct release labels, as a scalar subquery.

    One short text per release, so it stays small at any row count.
    """
    return df.agg(F.array_sort(F.collect_set(period)).alias("labels")).scalar()


def period_index(panel: DataFrame, period: str = "period", out: str = "t") -> DataFrame:
    """Add the 0-based position of each release in text order, without a join."""
    return panel.withColumn(
        out, (F.array_position(release_labels(panel, period), F.col(period)) - 1).cast("int")
    )

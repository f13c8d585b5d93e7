"""Group summaries shared by the query catalogue.

Means that need a join first are carried as (sum, count) per join key: the long
table shrinks to one row per facility before it meets another table, and a
facility with very many rows is reduced in the map tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.clean import fold, rating
from wardlens.functions.rounding import half_up
from wardlens.operators.ranking import rank_rows


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Values that differ only in case or outer blanks are listed once."""
    return merge_spellings(df.select(column).distinct(), [column], [], []).orderBy(column)


def count_by(df: DataFrame, column: str, out: str = "total_hospitals") -> DataFrame:
    """Rows per value; spellings that differ only in case or outer blanks count as one."""
    counts = df.groupBy(column).agg(F.count("*").alias(out))
    return merge_spellings(counts, [column], [], [out]).orderBy(F.desc(out), column)


def mean_by(df: DataFrame, by: Sequence[str], value: Column, out: str) -> DataFrame:
    """Unrounded mean of the non-null values; groups of nulls only stay, with NULL."""
    return df.select(*by, value.alias("_v")).groupBy(*by).agg(F.avg("_v").alias(out))


def text_mean_by(
    df: DataFrame, texts: Sequence[str], value: Column | str, out: str, by: Sequence[str] = ()
) -> DataFrame:
    """``mean_by`` over text columns whose letter case does not count; ``by`` is compared as it is."""
    parts = merge_spellings(mean_parts(df, [*by, *texts], value), texts, by, ["_sum", "_n"])
    return parts.select(*by, *texts, F.try_divide("_sum", "_n").alias(out))


def mean_parts(df: DataFrame, by: Sequence[str], value: Column | str) -> DataFrame:
    """Partial mean per key: ``_sum`` and ``_n`` of the non-null values."""
    value = F.col(value) if isinstance(value, str) else value
    return (
        df.select(*by, value.alias("_v")).groupBy(*by).agg(F.sum("_v").alias("_sum"), F.count("_v").alias("_n"))
    )


def merged_mean() -> Column:
    """Mean over partial means."""
    return F.try_divide(F.sum("_sum"), F.sum("_n"))


def rated(h: DataFrame) -> DataFrame:
    """Hospitals with a usable rating, as ``_rating``."""
    return h.withColumn("_rating", rating(h)).filter(F.col("_rating").isNotNull())


def group_means(h: DataFrame, by: str) -> DataFrame:
    """Mean rating ``_mean`` per value of ``by``, in any letter case."""
    return text_mean_by(rated(h), [by], "_rating", "_mean")


def avg_rating_by(h: DataFrame, by: str, digits: int | None = 2, out: str = "average_rating") -> DataFrame:
    """Mean rating per group, best first; ``digits=None`` keeps six decimals."""
    means = group_means(h, by)
    return means.select(by, half_up("_mean", 6 if digits is None else digits).alias(out)).orderBy(F.desc(out), by)


def rank_groups(h: DataFrame, by: str, out: str) -> DataFrame:
    """Groups ranked by their unrounded mean rating, range-placed whatever their number."""
    ranked = rank_rows(group_means(h, by), [("_mean", "desc")], [by], out)
    return ranked.select(by, half_up("_mean", 2).alias("average_rating"), out).orderBy(out, by)


def below_national(h: DataFrame, by: Sequence[str], out: str, show: bool = False, margin: float = 0.0) -> DataFrame:
    """Groups whose mean rating is below the mean of all rated rows by more than ``margin``.

    The national mean comes from the group sums, so the table is read once.
    """
    parts = merge_spellings(mean_parts(rated(h), by, "_rating"), by, [], ["_sum", "_n"])
    national = parts.agg(merged_mean().alias("m")).scalar()
    groups = parts.withColumn("_mean", F.col("_sum") / F.col("_n")).withColumn("_national", national)
    low = groups.filter(F.col("_mean") < F.col("_national") - F.lit(margin))
    cols = [*by, half_up("_mean", 2).alias(out)]
    if show:
        cols.append(half_up("_national", 2).alias("national_average"))
    return low.select(*cols).orderBy(out, *by)


def merge_spellings(parts: DataFrame, texts: Sequence[str], by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Join groups whose ``texts`` differ only in letter case.

    Works on rows already grouped by exact text, so only group rows are sorted here.
    The spelling shown is the first of the group in text order.
    """
    folds = [fold(c).alias(f"_fold_{c}") for c in texts]
    return (
        parts.groupBy(*by, *folds)
        .agg(*[F.min(c).alias(c) for c in texts], *[F.sum(c).alias(c) for c in sums])
        .select(*by, *texts, *sums)
    )


def same_label(df: DataFrame, text: str) -> DataFrame:
    """One spelling of ``text`` for all its groups, the first in text order. For group rows: few per value."""
    return df.withColumn(text, F.min(text).over(Window.partitionBy(fold(text))))

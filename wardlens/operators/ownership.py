"""How quality differs by owner and facility type (q16-q30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.clean import text_is, worse
from wardlens.functions.rounding import half_up
from wardlens.operators.grouping import mean_by, merge_spellings, rated, same_label, text_mean_by
from wardlens.operators.ranking import sort_rows, top_n_within

# The publisher's ownership words behind each profit class.
FOR_PROFIT = ("Proprietary",)
NON_PROFIT = (
    "Voluntary non-profit - Private",
    "Voluntary non-profit - Church",
    "Voluntary non-profit - Other",
)


def type_ownership_list(h: DataFrame) -> DataFrame:
    return sort_rows(h.select("facility_name", "hospital_type", "hospital_ownership"), "facility_name")


def _listed(h: DataFrame, column: str, value: str) -> DataFrame:
    rows = h.filter(text_is(h, column, value)).select("facility_name", "city_town", "state", column)
    return sort_rows(rows, "state", "facility_name")


def by_ownership(h: DataFrame, value: str = "Government - State") -> DataFrame:
    return _listed(h, "hospital_ownership", value)


def by_type(h: DataFrame, value: str = "Critical Access Hospitals") -> DataFrame:
    return _listed(h, "hospital_type", value)


def no_emergency(h: DataFrame) -> DataFrame:
    return _listed(h, "emergency_services", "No")


def avg_rating_having(h: DataFrame, by: str = "hospital_ownership", above: float = 3.5) -> DataFrame:
    """Groups whose unrounded mean rating is above a limit."""
    means = text_mean_by(rated(h), [by], "_rating", "_mean").filter(F.col("_mean") > above)
    return means.select(by, half_up("_mean", 2).alias("average_rating")).orderBy(F.desc("average_rating"), by)


def birthing_by_ownership(h: DataFrame) -> DataFrame:
    friendly = h.filter(text_is(h, "birthing_friendly", "Y"))
    counts = friendly.groupBy("hospital_ownership").agg(F.count("*").alias("birthing_friendly_hospitals"))
    merged = merge_spellings(counts, ["hospital_ownership"], [], ["birthing_friendly_hospitals"])
    return merged.orderBy(F.desc("birthing_friendly_hospitals"), "hospital_ownership")


def profit_class(c: str = "hospital_ownership") -> Column:
    key = F.lower(F.trim(F.col(c)))
    return (
        F.when(key.isin([v.lower() for v in FOR_PROFIT]), "For-Profit")
        .when(key.isin([v.lower() for v in NON_PROFIT]), "Non-Profit")
        .otherwise("Other")
    )


def profit_class_mortality(h: DataFrame) -> DataFrame:
    classed = h.withColumn("ownership_category", profit_class())
    means = mean_by(classed, ["ownership_category"], worse("mort", h).cast("double"), "_mean")
    return means.select("ownership_category", half_up("_mean", 2).alias("avg_mortality_measures")).orderBy(
        "ownership_category"
    )


def pct_zero_safety(h: DataFrame) -> DataFrame:
    """Share with no worse safety measure among all hospitals; missing is not zero."""
    zero = F.count_if(F.coalesce(worse("safety", h) == 0, F.lit(False)))
    counts = h.groupBy("hospital_ownership").agg(
        F.count("*").alias("total_hospitals"), zero.alias("zero_safety_hospitals")
    )
    return (
        merge_spellings(counts, ["hospital_ownership"], [], ["total_hospitals", "zero_safety_hospitals"])
        .withColumn(
            "percentage_zero_safety",
            half_up(F.col("zero_safety_hospitals") * 100.0 / F.col("total_hospitals"), 2),
        )
        .orderBy(F.desc("percentage_zero_safety"), "hospital_ownership")
    )


def v_type_ownership(h: DataFrame) -> DataFrame:
    """Rated hospitals per type and owner: count, mean rating, share with emergency services."""
    emergency = F.count_if(F.coalesce(text_is(h, "emergency_services", "Yes"), F.lit(False)))
    keys = ["hospital_type", "hospital_ownership"]
    sums = [F.count("*").alias("_n"), F.sum("_rating").alias("_sum"), emergency.alias("_emergency")]
    groups = merge_spellings(rated(h).groupBy(*keys).agg(*sums), keys, [], ["_n", "_sum", "_emergency"])
    for key in keys:
        groups = same_label(groups, key)
    return groups.select(
        *keys,
        F.col("_n").alias("total_hospitals"),
        half_up(F.col("_sum") / F.col("_n"), 2).alias("average_rating"),
        half_up(F.col("_emergency") * 100.0 / F.col("_n"), 2).alias("emergency_service_percentage"),
    )


def best_group_per(h: DataFrame, outer: str = "hospital_type", inner: str = "hospital_ownership") -> DataFrame:
    """The inner group with the best unrounded mean rating per outer group; ties by name."""
    means = same_label(text_mean_by(rated(h), [outer, inner], "_rating", "_mean"), outer)
    best = top_n_within(means, [outer], [F.desc_nulls_last("_mean"), F.asc(inner)], 1)
    return best.select(outer, inner, half_up("_mean", 2).alias("average_rating")).orderBy(outer)

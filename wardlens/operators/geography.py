"""Where low-rated providers cluster: states and counties (q01-q15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.clean import fold, number, text_is, worse
from wardlens.functions.rounding import half_up
from wardlens.operators.grouping import (
    avg_rating_by,
    count_by,
    distinct_values,
    mean_parts,
    merge_spellings,
    merged_mean,
    rank_groups,
    rated,
)
from wardlens.operators.ranking import sort_rows, top_n_within


def hospitals_in_state(h: DataFrame, state: str = "CA") -> DataFrame:
    rows = h.filter(text_is(h, "state", state)).select("facility_name", "city_town", "state", "overall_rating")
    return sort_rows(rows, "facility_name")


def distinct_states(h: DataFrame) -> DataFrame:
    return distinct_values(h, "state")


def with_rating(h: DataFrame, stars: int = 1) -> DataFrame:
    rows = h.filter(F.col("overall_rating") == str(stars)).select(
        "facility_name", "city_town", "county_parish", "state", "overall_rating"
    )
    return sort_rows(rows, "state", "facility_name")


def hospitals_in_county(h: DataFrame, county: str = "Los Angeles") -> DataFrame:
    """Type and ownership are both shown under their own names."""
    rows = h.filter(text_is(h, "county_parish", county)).select(
        "facility_name", "city_town", "county_parish", "hospital_type", "hospital_ownership"
    )
    return sort_rows(rows, "facility_name")


def top_rated(h: DataFrame, state: str = "TX", n: int = 20) -> DataFrame:
    stars = number(h, "overall_rating", "int")
    return (
        h.filter(text_is(h, "state", state) & stars.isNotNull())
        .orderBy(stars.desc(), F.asc("facility_name"), F.asc("facility_id"))
        .limit(n)
        .select("facility_name", "city_town", "overall_rating")
    )


def hospitals_per_state(h: DataFrame) -> DataFrame:
    return count_by(h, "state")


def avg_rating_per_state(h: DataFrame) -> DataFrame:
    """Six decimals, as a decimal mean shows them."""
    return avg_rating_by(h, "state", digits=None)


def low_rated_counties(h: DataFrame, more_than: int = 5, ratings: tuple[str, ...] = ("1", "2", "3")) -> DataFrame:
    spelled = h.filter(F.col("overall_rating").isin(*ratings)).groupBy("state", "county_parish").agg(
        F.count("*").alias("low_rated_hospitals")
    )
    return (
        merge_spellings(spelled, ["state", "county_parish"], [], ["low_rated_hospitals"])
        .filter(F.col("low_rated_hospitals") > more_than)
        .select("state", "county_parish", "low_rated_hospitals")
        .orderBy(F.desc("low_rated_hospitals"), "state", "county_parish")
    )


def emergency_split(h: DataFrame) -> DataFrame:
    def having(answer: str):
        return F.count_if(F.coalesce(text_is(h, "emergency_services", answer), F.lit(False)))

    counts = h.groupBy("state").agg(
        having("Yes").alias("emergency_hospitals"), having("No").alias("non_emergency_hospitals")
    )
    return merge_spellings(counts, ["state"], [], ["emergency_hospitals", "non_emergency_hospitals"]).orderBy("state")


def count_worse_by(h: DataFrame, group: str, by: str, out: str = "hospital_count", more_than: int | None = None) -> DataFrame:
    """Hospitals with at least one worse measure, per ``by``; optionally only large groups."""
    spelled = h.filter(worse(group, h) > 0).groupBy(by).agg(F.count("*").alias(out))
    counts = merge_spellings(spelled, [by], [], [out])
    if more_than is not None:
        counts = counts.filter(F.col(out) > more_than)
    return counts.orderBy(F.desc(out), by)


def rank_states(h: DataFrame) -> DataFrame:
    return rank_groups(h, "state", "state_rank")


def bottom_n_per(h: DataFrame, by: str = "state", n: int = 1) -> DataFrame:
    """The ``n`` lowest-rated hospitals of every group, in any letter case; ties by name, then id."""
    stars = h.withColumn("_stars", number(h, "overall_rating", "int")).filter(F.col("_stars").isNotNull())
    lowest = top_n_within(stars, [fold(by)], [F.asc("_stars"), F.asc("facility_name"), F.asc("facility_id")], n)
    return lowest.orderBy(fold(by), "rn").select(by, "facility_name", "city_town", "county_parish", "overall_rating")


def counties_below_national(h: DataFrame) -> DataFrame:
    """Counties (spelling variants joined) whose mean rating is below the national mean."""
    spelled = mean_parts(rated(h), ["county_parish", "state"], "_rating")
    parts = merge_spellings(spelled, ["county_parish", "state"], [], ["_sum", "_n"])
    national = spelled.agg(merged_mean()).scalar()
    mean = F.col("_sum") / F.col("_n")
    return (
        parts.filter(mean < national)
        .select("county_parish", "state", half_up(mean, 2).alias("county_average_rating"))
        .orderBy("county_average_rating", "state", "county_parish")
    )


def v_state_summary(h: DataFrame) -> DataFrame:
    """Count and mean rating of the rated hospitals per state; register as a view for reuse."""
    parts = merge_spellings(mean_parts(rated(h), ["state"], "_rating"), ["state"], [], ["_sum", "_n"])
    return parts.select(
        "state", F.col("_n").alias("total_hospitals"), half_up(F.col("_sum") / F.col("_n"), 2).alias("average_rating")
    )

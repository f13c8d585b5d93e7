"""Patient survey results (q61-q75). ``s`` is long: hospital x survey measure x period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.clean import composite_risk, fold, number, text_is
from wardlens.functions.rounding import half_up
from wardlens.operators.grouping import mean_by, mean_parts, merge_spellings, merged_mean, text_mean_by
from wardlens.operators.ranking import rank_rows, sort_rows, top_n_within
from wardlens.operators.safety import v_risk_summary
from wardlens.operators.timeliness import change_over_time, timely_mean_all

STAR = "patient_survey_star_rating"
RATE = "survey_response_rate_percent"
COMPLETED = "number_of_completed_surveys"


def starred(s: DataFrame) -> DataFrame:
    """Rows with a star rating, as ``_star``."""
    return s.withColumn("_star", number(s, STAR)).filter(F.col("_star").isNotNull())


def answers_for(s: DataFrame, name: str = "SOUTHEAST HEALTH MEDICAL CENTER") -> DataFrame:
    rows = s.filter(text_is(s, "facility_name", name)).select(
        "facility_name", "hcahps_question", "hcahps_answer_description", "hcahps_answer_percent"
    )
    return sort_rows(rows, "hcahps_question")


def five_star(s: DataFrame, measure: str = "H_STAR_RATING", stars: int = 5) -> DataFrame:
    rows = s.filter(text_is(s, "hcahps_measure_id", measure) & (F.col(STAR) == str(stars)))
    return sort_rows(rows.select("facility_name", "state", "hcahps_measure_id", STAR), "state", "facility_name")


def low_response(s: DataFrame, below: int = 20) -> DataFrame:
    return (
        s.filter(number(s, RATE, "int") < below)
        .select("facility_name", "state", RATE)
        .distinct()
        .orderBy("state", "facility_name", RATE)
    )


def top_completed(s: DataFrame, n: int = 15) -> DataFrame:
    return (
        s.select("facility_name", "state", number(s, COMPLETED, "int").alias("_done"))
        .filter(F.col("_done").isNotNull())
        .groupBy("facility_name", "state")
        .agg(F.max("_done").alias("completed_surveys"))
        .orderBy(F.desc("completed_surveys"), "facility_name", "state")
        .limit(n)
    )


def avg_star_by(s: DataFrame, h: DataFrame, by: str = "state") -> DataFrame:
    parts = mean_parts(starred(s), ["facility_id"], "_star")
    groups = parts.join(h.select("facility_id", by), "facility_id").groupBy(by)
    sums = groups.agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    return (
        merge_spellings(sums, [by], [], ["_sum", "_n"])
        .select(by, half_up(F.try_divide("_sum", "_n"), 2).alias("avg_star_rating"))
        .orderBy(F.desc("avg_star_rating"), by)
    )


def avg_answer_by_measure(s: DataFrame) -> DataFrame:
    answered = s.withColumn("_pct", number(s, "hcahps_answer_percent")).filter(F.col("_pct").isNotNull())
    means = text_mean_by(answered, ["hcahps_measure_id"], "_pct", "_mean")
    return means.select("hcahps_measure_id", half_up("_mean", 2).alias("avg_answer_percent")).orderBy(
        "avg_answer_percent", "hcahps_measure_id"
    )


def low_response_by_ownership(s: DataFrame, h: DataFrame, below: int = 30) -> DataFrame:
    """Hospitals are made distinct before the join, so it meets one row per hospital."""
    low = s.filter(number(s, RATE, "int") < below).select("facility_id").distinct()
    owners = h.select("facility_id", "hospital_ownership")
    return (
        low.join(owners, "facility_id")
        .groupBy(fold("hospital_ownership").alias("_owner"))
        .agg(
            F.min("hospital_ownership").alias("hospital_ownership"),
            F.countDistinct("facility_id").alias("low_response_hospitals"),
        )
        .drop("_owner")
        .orderBy(F.desc("low_response_hospitals"), "hospital_ownership")
    )


def _hospital_stars(s: DataFrame, h: DataFrame, keys: list[str]) -> DataFrame:
    """Mean star per hospital with the state of its general record."""
    parts = mean_parts(starred(s), keys, "_star")
    return (
        parts.join(h.select("facility_id", "state"), "facility_id")
        .groupBy(*keys, fold("state").alias("_state"))
        .agg(F.min("state").alias("state"), merged_mean().alias("_mean"))
    )


def states_many_low(s: DataFrame, h: DataFrame, below: float = 3.0, more_than: int = 20) -> DataFrame:
    low = _hospital_stars(s, h, ["facility_id"]).filter(F.col("_mean") < below)
    counts = low.groupBy("state").agg(F.count("*").alias("low_rated_hospitals"))
    return (
        merge_spellings(counts, ["state"], [], ["low_rated_hospitals"])
        .filter(F.col("low_rated_hospitals") > more_than)
        .orderBy(F.desc("low_rated_hospitals"), "state")
    )


def risk_category(c: str = "composite_risk_score") -> Column:
    score = F.col(c)
    return (
        F.when(score >= 3, "High Risk").when(score.between(1, 2), "Medium Risk").otherwise("Low Risk")
    )


def risk_vs_satisfaction(h: DataFrame, s: DataFrame) -> DataFrame:
    stars = mean_by(starred(s), ["facility_id"], F.col("_star"), "_mean")
    buckets = v_risk_summary(h).select("facility_id", risk_category().alias("risk_category"))
    return (
        buckets.join(stars, "facility_id")
        .groupBy("risk_category")
        .agg(F.count("*").alias("total_hospitals"), half_up(F.avg("_mean"), 2).alias("avg_patient_star_rating"))
        .orderBy(F.desc("avg_patient_star_rating"), "risk_category")
    )


def top_star_per_state(s: DataFrame, h: DataFrame) -> DataFrame:
    stars = _hospital_stars(s, h, ["facility_id", "facility_name"])
    top = top_n_within(
        stars, ["_state"], [F.desc_nulls_last("_mean"), F.asc("facility_name"), F.asc("facility_id")], 1
    )
    return top.select("state", "facility_name", half_up("_mean", 2).alias("avg_star_rating")).orderBy("state")


def v_patient_experience(s: DataFrame, h: DataFrame) -> DataFrame:
    """Mean star, best response rate and survey count per hospital; hospitals without stars stay."""
    per_hospital = s.groupBy("facility_id", "facility_name").agg(
        F.sum(number(s, STAR)).alias("_sum"),
        F.count(number(s, STAR)).alias("_n"),
        F.max(number(s, RATE, "int")).alias("_rate"),
        F.max(number(s, COMPLETED, "int")).alias("_done"),
    )
    return (
        per_hospital.join(h.select("facility_id", "state", "hospital_ownership"), "facility_id")
        .groupBy("facility_id", "facility_name", "state", "hospital_ownership")
        .agg(
            half_up(merged_mean(), 2).alias("avg_star_rating"),
            F.max("_rate").alias("response_rate_percent"),
            F.max("_done").alias("completed_surveys"),
        )
    )


def response_change(s: DataFrame) -> DataFrame:
    """Best response rate per hospital and period, and its change to the period before."""
    rates = (
        s.select("facility_id", "facility_name", "start_date", "end_date", number(s, RATE, "int").alias("_rate"))
        .filter(F.col("_rate").isNotNull())
        .groupBy("facility_id", "facility_name", "start_date", "end_date")
        .agg(F.max("_rate").alias("response_rate"))
    )
    changed = change_over_time(rates, ["facility_id"], "response_rate", "previous_response_rate", "response_rate_change")
    return changed.select(
        "facility_name", "start_date", "end_date", "response_rate", "previous_response_rate", "response_rate_change"
    ).orderBy("facility_name", "start_date", "end_date")


def scorecard_rows(h: DataFrame, t: DataFrame, s: DataFrame) -> DataFrame:
    """One row per hospital found in all three tables.

    Stars count up to 100, timeliness as it is, every worse measure costs 10 points.
    """
    stars = mean_by(starred(s), ["facility_id"], F.col("_star"), "_star_mean")
    timely = timely_mean_all(t, "_timely_mean")
    risk = h.select("facility_id", "facility_name", "state", composite_risk(h).cast("long").alias("composite_risk_score"))
    overall = F.col("_star_mean") * 20 + F.col("_timely_mean") - F.col("composite_risk_score") * 10
    return (
        risk.join(timely, "facility_id")
        .join(stars, "facility_id")
        .select(
            "facility_id",
            "facility_name",
            "state",
            "composite_risk_score",
            half_up("_timely_mean", 2).alias("avg_timely_score"),
            half_up("_star_mean", 2).alias("avg_star_rating"),
            half_up(overall, 2).alias("overall_score"),
        )
    )


def scorecard(h: DataFrame, t: DataFrame, s: DataFrame) -> DataFrame:
    """National rank on the rounded overall score."""
    ranked = rank_rows(scorecard_rows(h, t, s), [("overall_score", "desc")], ["facility_id"], "national_rank")
    return sort_rows(ranked.drop("facility_id"), "national_rank", "facility_name")

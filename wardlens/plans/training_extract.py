"""Training extract for rating models: typed counts of the rated hospitals with survey and timely means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.functions.clean import number
from wardlens.operators.timeliness import timely_mean_all

COUNTS = tuple(f"count_{g}_measures_{k}" for g in ("mort", "safety", "readm") for k in ("better", "no_different", "worse"))


def survey_means(s: DataFrame) -> DataFrame:
    """Mean star and response rate, and completed surveys added up over the measure rows."""
    return s.groupBy("facility_id").agg(
        F.avg(number(s, "patient_survey_star_rating")).alias("avg_patient_star_rating"),
        F.avg(number(s, "survey_response_rate_percent")).alias("avg_response_rate"),
        F.sum(number(s, "number_of_completed_surveys", "int")).alias("total_completed_surveys"),
    )


def training_extract(h: DataFrame, t: DataFrame, s: DataFrame) -> DataFrame:
    rated = h.select(
        "facility_id", "facility_name", "state", "hospital_type", "hospital_ownership",
        "emergency_services", "birthing_friendly",
        *[number(h, c, "int").alias(c) for c in COUNTS],
        number(h, "overall_rating", "int").alias("overall_rating"),
    ).filter(F.col("overall_rating").isNotNull())
    joined = rated.join(timely_mean_all(t), "facility_id", "left").join(survey_means(s), "facility_id", "left")
    return joined.select(*[c for c in joined.columns if c != "overall_rating"], "overall_rating")

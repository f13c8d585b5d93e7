"""Reading the scored list: state picker, risk triage, one-hospital profile, model card."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.clean import same_text
from wardlens.functions.rounding import half_even
from wardlens.operators.grouping import distinct_values
from wardlens.operators.ranking import rank_by_value

ALL_STATES = "All"


def risk_rank(scored: DataFrame, risk: str = "predicted_risk") -> DataFrame:
    """Rank by the rounded risk, highest first; equal risks share the best rank."""
    return rank_by_value(scored, risk, "desc", "risk_rank").orderBy(F.desc_nulls_last(risk), "facility_id")


def state_list(scored: DataFrame) -> DataFrame:
    return distinct_values(scored.filter(F.col("state").isNotNull()), "state")


def triage(scored: DataFrame, state: str = ALL_STATES, n: int = 15) -> DataFrame:
    """The ``n`` riskiest hospitals of a state, in any letter case, or of all."""
    view = scored if state == ALL_STATES else scored.filter(same_text("state", state))
    return (
        view.orderBy(F.desc_nulls_last("predicted_risk"), F.asc("facility_id"))
        .limit(n)
        .select(
            "risk_rank", "facility_name", "state", "hospital_type",
            F.col("predicted_risk").alias("risk_score (0-1)"), "overall_rating",
            F.col("patient_star_avg").alias("patient_stars"),
        )
    )


def profile(scored: DataFrame, features: DataFrame, name: str) -> DataFrame:
    """Score and features of the riskiest hospital of that name; missing values stay missing."""
    row = (
        scored.filter(F.col("facility_name") == name)
        .orderBy(F.desc_nulls_last("predicted_risk"), F.asc("facility_id"))
        .limit(1)
        .select("facility_id", "facility_name", "predicted_risk", "overall_rating", "patient_star_avg", "risk_rank")
    )
    known = features.select(
        "facility_id", "state", F.col("hospital_type").alias("type"), F.col("hospital_ownership").alias("ownership"),
        (F.col("emergency_services") == 1).alias("emergency_services"), "survey_response_rate", "timely_care_avg",
    )
    # The left side is a single row.
    return known.join(F.broadcast(row), "facility_id").select(
        "facility_name",
        half_even(F.col("predicted_risk") * 100, 0).alias("predicted_risk_pct"),
        half_even("overall_rating", 0).alias("overall_rating"),
        half_even("patient_star_avg", 1).alias("patient_star_avg"),
        "risk_rank", "state", "type", "ownership", "emergency_services",
        F.col("survey_response_rate").alias("survey_response_rate_pct"),
        half_even("timely_care_avg", 1).alias("timely_care_avg"),
    )


def model_card(metrics: DataFrame) -> DataFrame:
    """The fields of the metrics document a model card shows, one row per task."""
    regression = metrics.select(
        F.lit("regression").alias("task"), "regression.target", "regression.n_train", "regression.n_test",
        F.col("regression.r2").alias("score"), F.col("regression.mae_stars").alias("detail"),
    )
    flagged = F.col("classification.report")["1"]["recall"]
    classification = metrics.select(
        F.lit("classification").alias("task"), "classification.target", "classification.n_train",
        "classification.n_test", F.col("classification.roc_auc").alias("score"), half_even(flagged, 2).alias("detail"),
    )
    return regression.unionByName(classification)


METRICS_SCHEMA = (
    "regression struct<target:string,n_train:bigint,n_test:bigint,r2:double,mae_stars:double>,"
    "classification struct<target:string,n_train:bigint,n_test:bigint,roc_auc:double,accuracy:double,"
    "report:map<string,struct<precision:double,recall:double,f1_score:double,support:bigint>>>"
)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(path)

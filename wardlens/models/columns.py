"""Predictor, target and barred columns of the two tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Column names of the published feature table.
CATEGORICAL = ("state", "hospital_type", "hospital_ownership")
REG_NUMERIC = ("emergency_services", "survey_response_rate", "completed_surveys", "timely_care_avg")
CLF_NUMERIC = (*REG_NUMERIC, "patient_star_avg")

# Columns that name a hospital or from which its label can be worked out.
LEAKAGE = (
    "facility_id", "facility_name", "county", "overall_rating",
    "_mort_worse", "_safety_worse", "_readm_worse",
    "composite_risk_score", "is_underperformer", "patient_star_avg",
)


@dataclass(frozen=True)
class Task:
    name: str
    target: str
    numeric: tuple[str, ...]
    scoring: str
    classification: bool


TASKS = {
    "regression": Task("regression", "patient_star_avg", REG_NUMERIC, "r2", False),
    "classification": Task("classification", "is_underperformer", CLF_NUMERIC, "roc_auc", True),
}


def task_of(name: str) -> Task:
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}; there are {', '.join(sorted(TASKS))}")
    return TASKS[name]


def select_x(df: DataFrame, task: str) -> DataFrame:
    """Predictors of a task. The mean star is a predictor only when it is not the target."""
    keep = task_of(task).numeric
    return df.drop(*[c for c in LEAKAGE if c not in keep])


def model_rows(df: DataFrame, task: str) -> DataFrame:
    """Id, predictors and ``label``; for regression only rows with a target."""
    t = task_of(task)
    rows = df.select("facility_id", *CATEGORICAL, *t.numeric, df[t.target].cast("double").alias("label"))
    return rows if t.classification else rows.filter("label IS NOT NULL")

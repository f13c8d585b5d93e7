"""Registered modelling jobs over the feature table of the derived provider tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.provider_tables import provider
from checks.registry_jobs import feature_table
from wardlens.functions.rounding import half_even
from wardlens.models import candidates, columns, explain, splits, train, validate
from wardlens.models.preprocess import Preprocessor, feature_names
from wardlens.sources.scratch import materialize, scratch_path
from wardlens.sources.sinks import save_model

Query = Callable[[SparkSession, str], DataFrame]
Sizes = candidates.Sizes

SIZES = Sizes()  # full settings, for single fits and the leaderboard
RARE_BELOW = 60


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(*[provider(spark, sf_dir, n) for n in ("facility", "timely", "survey")])


def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table written once, since fitting reads it many times."""
    return materialize(features(spark, sf_dir), "features")


def fitted(spark: SparkSession, sf_dir: str, task: str):
    """The forest of a task with its held-out predictions and the table it was fitted on."""
    table = stored_features(spark, sf_dir)
    fit = train.train_underperformer if task == "classification" else train.train_satisfaction
    return fit(table, SIZES), table


def _rows(task: str) -> Query:
    return lambda spark, sf_dir: columns.model_rows(features(spark, sf_dir), task)


def _prepared(spark: SparkSession, sf_dir: str, min_rows: int = RARE_BELOW) -> tuple[DataFrame, list[str]]:
    rows = columns.model_rows(stored_features(spark, sf_dir), "classification")
    fitted = Preprocessor(columns.CLF_NUMERIC, min_rows).fit(rows)
    return fitted.transform(rows), feature_names(fitted)


def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name of the set category slots of every row, read back from the vector."""
    df, names = _prepared(spark, sf_dir)
    cats = len(names) - len(columns.CLF_NUMERIC)
    labels = F.array(*[F.lit(n) for n in names[:cats]])
    slots = F.filter(F.arrays_zip(labels.alias("name"), F.slice(vector_to_array("features"), 1, cats).alias("on")), lambda x: x["on"] == 1)
    return df.select("facility_id", F.array_join(F.array_sort(F.transform(slots, lambda x: x["name"])), "|").alias("slots"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, found = _prepared(spark, sf_dir)
    array = F.array(*[F.lit(n) for n in found])
    return df.select(F.posexplode(array).alias("position", "feature")).distinct().select(
        F.col("position").cast("long").alias("position"), "feature"
    )


def impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = _prepared(spark, sf_dir)
    return df.select("facility_id", *[half_even(f"{c}_full", 6).alias(c) for c in columns.CLF_NUMERIC])


def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = _prepared(spark, sf_dir)
    return df.select("facility_id", *[half_even(f"{c}_scaled", 6).alias(c) for c in columns.CLF_NUMERIC])


def split(stratify: bool) -> Query:
    task = "classification" if stratify else "regression"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fit_rows, held = splits.hold_out(columns.model_rows(features(spark, sf_dir), task), stratify=stratify)
        both = fit_rows.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("test")))
        return both.select("facility_id", "label", "part")

    return run


def folds(stratify: bool) -> Query:
    task = "classification" if stratify else "regression"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = columns.model_rows(features(spark, sf_dir), task)
        return splits.contiguous_folds(rows, stratify=stratify).select("facility_id", "label", F.col("fold").cast("long").alias("fold"))

    return run


def candidate(task: str, model: str) -> Query:
    """One candidate fitted on the training rows; its held-out predictions."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fit_rows, held = splits.hold_out(
            columns.model_rows(features(spark, sf_dir), task), stratify=task == "classification"
        )
        prepared = Preprocessor(columns.task_of(task).numeric).fit(fit_rows)
        ready = materialize(prepared.transform(fit_rows).select("label", "features"), "ready")
        made = candidates.candidate_models(task, SIZES)[model].fit(ready)
        predicted = made.transform(prepared.transform(held).select("facility_id", "label", "features"))
        return predicted.select("facility_id", "label", half_even("prediction", 9).alias("prediction"))

    return run


def forest_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir, "regression")[0].tested


def forest_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitted(spark, sf_dir, "classification")[0].tested


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train.evaluate(*train.train_both(stored_features(spark, sf_dir), SIZES))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, table = fitted(spark, sf_dir, "classification")
    return train.score(table, result.model)


def stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model saved, loaded and used for scoring."""
    from pyspark.ml import PipelineModel

    result, table = fitted(spark, sf_dir, "classification")
    path = scratch_path(spark, "model")
    save_model(result.model, path)
    return train.score(table, PipelineModel.load(path))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten candidates at full size."""
    return validate.compare_models(stored_features(spark, sf_dir), SIZES)


def leaderboard_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.compare_models(stored_features(spark, sf_dir), SIZES, models=["Baseline (mean)", "Baseline (majority)"])


def _explained(fn: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result, table = fitted(spark, sf_dir, "classification")
        return fn(result.model, columns.model_rows(table, "classification"))

    return run


def models() -> dict[str, Query]:
    return {
        "m_select": lambda spark, sf_dir: columns.select_x(features(spark, sf_dir), "classification"),
        "m_select_reg": lambda spark, sf_dir: columns.select_x(features(spark, sf_dir), "regression"),
        "m_features": _rows("classification"),
        "m_features_reg": _rows("regression"),
        "m_encode": encode,
        "m_impute": impute,
        "m_scale": scale,
        "m_names": names,
        "m_split": split(False),
        "m_split_stratified": split(True),
        "m_folds": folds(False),
        "m_folds_stratified": folds(True),
        "m_rf_reg": forest_regression,
        "m_rf_clf": forest_classification,
        "m_baseline": candidate("regression", "Baseline (mean)"),
        "m_baseline_majority": candidate("classification", "Baseline (majority)"),
        "m_linear": candidate("regression", "Ridge"),
        "m_linear_logistic": candidate("classification", "LogisticRegression"),
        "m_boost": candidate("regression", "GradientBoosting"),
        "m_boost_clf": candidate("classification", "GradientBoosting"),
        "m_boost400": candidate("regression", "GradientBoosting (long)"),
        "m_boost400_clf": candidate("classification", "GradientBoosting (long)"),
        "m_cv": leaderboard,
        "m_cv_baseline": leaderboard_baseline,
        "m_score": scored,
        "e_metrics": document,
        "e_explain": _explained(lambda model, rows: explain.explain(model, rows, "classification")),
        "e_explain_split": _explained(lambda model, rows: explain.split_importance(model)),
        "e_explain_permutation": _explained(
            lambda model, rows: explain.permutation_importance(model, rows, "classification")
        ),
        "sink_model": stored_model,
    }




"""Fit the two models, measure them on held-out rows, score and rank every hospital."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from wardlens.functions.rounding import half_even
from wardlens.models import metrics
from wardlens.models.candidates import Sizes, forest_classifier, forest_regressor
from wardlens.models.columns import CATEGORICAL, CLF_NUMERIC, REG_NUMERIC, model_rows
from wardlens.models.documents import metrics_document
from wardlens.models.preprocess import Preprocessor
from wardlens.models.splits import SEED, TEST_SHARE, hold_out
from wardlens.models.triage import risk_rank
from wardlens.sources.scratch import materialize


@dataclass(frozen=True)
class Trained:
    """A stored-form model with the rows it was fitted on and held-out predictions."""

    model: PipelineModel
    train: DataFrame
    tested: DataFrame


def train_satisfaction(features: DataFrame, sizes: Sizes = Sizes(), test: float = TEST_SHARE, seed: int = SEED) -> Trained:
    """Mean patient star from structural and process columns."""
    train, held = hold_out(model_rows(features, "regression"), test, seed)
    prepared = Preprocessor(REG_NUMERIC).fit(train)
    forest = forest_regressor(sizes).fit(prepared.transform(train))
    model = PipelineModel([prepared, forest])
    return Trained(model, train, materialize(model.transform(held).select("facility_id", "label", "prediction"), "tested"))


def train_underperformer(features: DataFrame, sizes: Sizes = Sizes(), test: float = TEST_SHARE, seed: int = SEED) -> Trained:
    """Underperformer flag; the split keeps the class shares, the forest weighs classes evenly."""
    train, held = hold_out(model_rows(features, "classification"), test, seed, stratify=True)
    prepared = Preprocessor(CLF_NUMERIC).fit(train)
    forest = forest_classifier(sizes).fit(prepared.transform(train))
    model = PipelineModel([prepared, forest])
    return Trained(model, train, materialize(with_risk(model, held).select("facility_id", "label", "score"), "tested"))


def train_both(features: DataFrame, sizes: Sizes = Sizes()) -> tuple[Trained, Trained]:
    """Both models, fitted at the same time: the many short jobs of one leave room for the tasks of the other."""
    fits = map(inheritable_thread_target(features.sparkSession), (train_satisfaction, train_underperformer))
    with ThreadPool(2) as pool:
        satisfaction, underperformer = pool.map(lambda fit: fit(features, sizes), list(fits))
    return satisfaction, underperformer


def with_risk(model: PipelineModel, rows: DataFrame, out: str = "score") -> DataFrame:
    """Probability of the positive class."""
    return model.transform(rows).withColumn(out, vector_to_array("probability")[1])


def score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """Risk of every hospital, three decimals, ranked. Rows are scored once and written."""
    shown = ["facility_id", "facility_name", *CATEGORICAL, "overall_rating", "patient_star_avg"]
    scored = with_risk(model, features).select(*shown, half_even("score", 3).alias("predicted_risk"))
    return risk_rank(materialize(scored, "scored"))


def evaluate(satisfaction: Trained, underperformer: Trained) -> DataFrame:
    """The metrics document of both models."""
    sizes = {
        "regression": (satisfaction.train.count(), satisfaction.tested.count()),
        "classification": (underperformer.train.count(), underperformer.tested.count()),
    }
    return metrics_document(
        metrics.regression_metrics(satisfaction.tested),
        metrics.roc_auc(underperformer.tested, digits=3),
        metrics.classification_report(underperformer.tested, digits=9),
        sizes,
    )


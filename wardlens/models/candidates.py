"""Candidate models of the two tasks, by name, with a constant prediction as yardstick."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.models.booster import Booster, Growth
from wardlens.models.columns import task_of
from wardlens.models.forest import Forest, Rules


@dataclass(frozen=True)
class Sizes:
    """Model sizes. The defaults are the full settings; Spark trees stop at depth 30."""

    trees: int = 300
    tree_depth: int = 30
    min_leaf: int = 5
    boost_rounds: int = 100
    boost_leaves: int = 31
    long_rounds: int = 400
    long_depth: int = 5
    long_rate: float = 0.05
    max_iter: int = 1000
    seed: int = 42


class Constant(Estimator):
    """Predicts the training mean, or the most frequent class (ties: the lower label)."""

    def __init__(self, classification: bool):
        super().__init__()
        self.classification = classification

    def _fit(self, dataset: DataFrame) -> Transformer:
        if self.classification:
            counts = dataset.groupBy("label").count()
            top = counts.where("label IS NOT NULL").orderBy(F.desc("count"), F.asc("label")).first()
            value = top["label"] if top else None
        else:
            value = dataset.agg(F.avg("label")).first()[0]
        if value is None:
            raise ValueError("a constant needs at least one training row with a label")
        number = f"CAST('{float(value)!r}' AS DOUBLE)"
        return SQLTransformer(statement=f"SELECT *, {number} AS prediction, {number} AS rawPrediction FROM __THIS__")


class Ridge(Estimator):
    """Least squares with penalty ``alpha`` on the squared weights.

    The normal-equation solver divides its penalty by the label's deviation and its loss
    by the number of rows; both are undone here.
    """

    def __init__(self, alpha: float = 1.0):
        super().__init__()
        self.alpha = alpha

    def _fit(self, dataset: DataFrame) -> Transformer:
        n, spread = dataset.agg(F.count("label"), F.stddev_pop("label")).first()
        penalty = self.alpha * (spread or 1.0) / n
        return LinearRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal").fit(dataset)


class Balanced(Estimator):
    """Classifier that gives both classes the same total weight; ``make`` gets the row count."""

    def __init__(self, make: Callable[[int], Estimator]):
        super().__init__()
        self.make = make

    def _fit(self, dataset: DataFrame) -> Transformer:
        counts = {r["label"]: r["count"] for r in dataset.groupBy("label").count().collect()}
        n = sum(counts.values())
        weight = F.lit(1.0)
        for label, rows in counts.items():
            weight = F.when(F.col("label") == label, n / (len(counts) * rows)).otherwise(weight)
        return self.make(n).fit(dataset.withColumn("class_weight", weight))


def forest_regressor(s: Sizes = Sizes()) -> Estimator:
    return Forest(Rules(s.trees, s.tree_depth, s.min_leaf, seed=s.seed), classification=False)


def forest_classifier(s: Sizes = Sizes()) -> Estimator:
    rules = Rules(s.trees, s.tree_depth, s.min_leaf, seed=s.seed)
    return Balanced(lambda n: Forest(rules, classification=True, weight="class_weight", root_subset=True))


def candidate_models(task: str, s: Sizes = Sizes()) -> dict[str, Estimator]:
    """Leaderboard entries by name. The linear penalties match a ridge alpha of 1 and a logistic C of 1."""
    classification = task_of(task).classification
    boost = Booster(Growth(s.boost_rounds, 0.1, s.boost_leaves, min_rows=20, classification=classification))
    long = Booster(
        Growth(
            s.long_rounds, s.long_rate, 2**s.long_depth, s.long_depth, min_rows=1, min_hessian=1.0, l2=1.0,
            classification=classification,
        )
    )
    if not classification:
        return {
            "Baseline (mean)": Constant(False),
            "Ridge": Ridge(),
            "RandomForest": forest_regressor(s),
            "GradientBoosting": boost,
            "GradientBoosting (long)": long,
        }
    return {
        "Baseline (majority)": Constant(True),
        "LogisticRegression": Balanced(
            lambda n: LogisticRegression(
                maxIter=s.max_iter, regParam=1.0 / n, elasticNetParam=0.0, standardization=False, weightCol="class_weight"
            )
        ),
        "RandomForest": forest_classifier(s),
        "GradientBoosting": boost,
        "GradientBoosting (long)": long,
    }

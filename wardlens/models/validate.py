"""Cross-validated leaderboard of the candidate models."""

from __future__ import annotations

import statistics
from collections.abc import Iterable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.models.booster import Booster, BoosterModel, fit_many
from wardlens.models.candidates import Sizes, candidate_models
from wardlens.models.columns import TASKS, Task, model_rows
from wardlens.models.preprocess import Preprocessor
from wardlens.models.splits import FOLDS, contiguous_folds
from wardlens.sources.scratch import materialize

LEADERBOARD = "task string, scoring string, model string, cv_mean double, cv_std double"


def _evaluator(task: Task) -> BinaryClassificationEvaluator | RegressionEvaluator:
    if task.classification:
        return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    return RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="r2")


def fold_scores(
    features: DataFrame, task_name: str, sizes: Sizes = Sizes(), k: int = FOLDS, models: Iterable[str] | None = None,
    parallelism: int = FOLDS,
) -> dict[str, list[float]]:
    """Score of every candidate on every fold.

    Preparation is fitted once per fold on its training rows, and the prepared rows are
    written once and shared by the candidates. Boosters grow the models of all folds together, in
    passes over one table. The other fits are submitted fold by fold side by side, as the
    tuning classes of Spark ML do, so the cluster stays busy between small jobs.
    """
    task = TASKS[task_name]
    folded = materialize(contiguous_folds(model_rows(features, task_name), k, stratify=task.classification), "folds")
    candidates = candidate_models(task_name, sizes)
    wanted = list(models) if models is not None else list(candidates)
    boosters = [name for name in wanted if isinstance(candidates[name], Booster)]

    def one_fold(fold: int) -> tuple[DataFrame, dict[str, float]]:
        prepared = Preprocessor(task.numeric).fit(folded.filter(F.col("fold") != fold))
        ready = materialize(prepared.transform(folded).select("facility_id", "fold", "label", "features"), "fold")
        fit_rows, held = ready.filter(F.col("fold") != fold), ready.filter(F.col("fold") == fold)
        others = [name for name in wanted if name not in boosters]
        return ready, {name: _evaluator(task).evaluate(candidates[name].fit(fit_rows).transform(held)) for name in others}

    # Wrapped once per fold: each wrapper carries its own copy of the thread's job properties.
    threaded = inheritable_thread_target(features.sparkSession)
    tasks = [threaded(partial(one_fold, fold)) for fold in range(k)]
    with ThreadPool(max(1, min(parallelism, k))) as pool:
        per_fold = pool.map(lambda task: task(), tasks)
    scores = {name: [found[name] for _, found in per_fold] for name in wanted if name not in boosters}
    if boosters:
        ready = [table for table, _ in per_fold]
        training = [t.filter(F.col("fold") != fold).select(F.lit(fold).alias("model"), "label", "features") for fold, t in enumerate(ready)]
        together = reduce(DataFrame.unionByName, training)
        for name in boosters:
            fitted = fit_many(together, candidates[name].rules, "model")
            scores[name] = [
                _evaluator(task).evaluate(BoosterModel(fitted[fold], task.classification).transform(t.filter(F.col("fold") == fold)))
                for fold, t in enumerate(ready)
            ]
    return {name: scores[name] for name in wanted}


def compare_models(
    features: DataFrame, sizes: Sizes = Sizes(), k: int = FOLDS, tasks: Iterable[str] = tuple(TASKS),
    models: Iterable[str] | None = None,
) -> DataFrame:
    """Mean and population deviation over the folds, best model of each task first.

    ``models`` limits the candidates by name; it must leave some for every task.
    """
    rows = []
    for name in tasks:
        chosen = None if models is None else [m for m in candidate_models(name, sizes) if m in set(models)]
        for model, values in fold_scores(features, name, sizes, k, chosen).items():
            rows.append(
                (name, TASKS[name].scoring, model, round(statistics.fmean(values), 4), round(statistics.pstdev(values), 4))
            )
    board = features.sparkSession.createDataFrame(rows, LEADERBOARD)
    return board.orderBy("task", F.desc("cv_mean"), "model")

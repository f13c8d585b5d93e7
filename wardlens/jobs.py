"""The steps of the pipeline as commands, each reading and writing folders.

    python -m wardlens.jobs features  --data raw/ --out features/
    python -m wardlens.jobs snapshots --data archives/ --out snapshots/
    python -m wardlens.jobs panel     --data snapshots/ --out panel/
    python -m wardlens.jobs trends    --data panel/ --out trends/
    python -m wardlens.jobs train     --data features/ --out models/
    python -m wardlens.jobs compare   --data features/ --out leaderboard/
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.models import explain, train, validate
from wardlens.models.candidates import Sizes
from wardlens.models.columns import model_rows
from wardlens.plans import panel as panels
from wardlens.plans import trends as trend_plans
from wardlens.session import build_session
from wardlens.sources import archives, profiling, sinks, snapshots


def features(spark: SparkSession, data: str, out: str) -> dict[str, DataFrame]:
    """Feature table of one release; coverage and label balance for a first look."""
    sinks.write_table(snapshots.load_release(spark, data), out)
    table = spark.read.parquet(out)
    return {"coverage": profiling.coverage(table), "balance": profiling.balance(table, "is_underperformer")}


def build_snapshots(spark: SparkSession, data: str, out: str) -> dict[str, DataFrame]:
    archives.build_snapshots(spark, data, out)
    return {"releases": snapshots.load_snapshot_table(spark, out).groupBy("period").count().orderBy("period")}


def panel(spark: SparkSession, data: str, out: str) -> dict[str, DataFrame]:
    """Panel with changes, from ``period=`` Parquet folders or from a folder of CSV files per release."""
    if snapshots.has_csv(spark, data):
        stacked = snapshots.load_snapshots(spark, data)
    else:
        stacked = snapshots.load_snapshot_table(spark, data)
    sinks.write_table(panels.add_deltas(stacked), out, ["period"])
    return {"summary": profiling.panel_summary(snapshots.load_snapshot_table(spark, out))}


def trends(spark: SparkSession, data: str, out: str) -> dict[str, DataFrame]:
    table = snapshots.load_snapshot_table(spark, data)
    sinks.write_table(trend_plans.early_warning(table), f"{out}/hospitals")
    national = trend_plans.national_trends(table)
    sinks.write_table(national, f"{out}/national", fmt="csv")
    sinks.write_table(trend_plans.indexed_trends(national), f"{out}/indexed", fmt="csv")
    flagged = spark.read.parquet(f"{out}/hospitals").agg(
        F.count("*").alias("hospitals"), F.sum("declining_trajectory").alias("declining")
    )
    return {"flagged": flagged}


def train_models(spark: SparkSession, data: str, out: str, sizes: Sizes = Sizes()) -> dict[str, DataFrame]:
    """Both models, their metrics, explanations, and the ranked list of all hospitals."""
    table = spark.read.parquet(data)
    fitted = {
        "regression": train.train_satisfaction(table, sizes),
        "classification": train.train_underperformer(table, sizes),
    }
    for task, result in fitted.items():
        sinks.save_model(result.model, f"{out}/{task}_model")
        drivers = explain.explain(result.model, model_rows(table, task), task)
        sinks.write_table(drivers, f"{out}/{task}_drivers", fmt="csv")
    metrics = train.evaluate(fitted["regression"], fitted["classification"])
    sinks.write_metrics(metrics, f"{out}/metrics")
    sinks.write_table(train.score(table, fitted["classification"].model), f"{out}/scored")
    return {"metrics": spark.read.json(f"{out}/metrics")}


def compare(spark: SparkSession, data: str, out: str, sizes: Sizes = Sizes()) -> dict[str, DataFrame]:
    board = validate.compare_models(spark.read.parquet(data), sizes)
    sinks.write_table(board, out, fmt="csv")
    return {"leaderboard": board}


STEPS = {
    "features": features,
    "snapshots": build_snapshots,
    "panel": panel,
    "trends": trends,
    "train": train_models,
    "compare": compare,
}


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wardlens.jobs", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("step", choices=list(STEPS))
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    args = parser.parse_args(argv)
    for name, result in STEPS[args.step](build_session(f"wardlens-{args.step}"), args.data, args.out).items():
        print(name)
        result.show(result.count(), truncate=False)


if __name__ == "__main__":
    main()

"""The nested metrics document, built from metric frames of one row (or one row per class)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, *columns: str) -> Column:
    """A one-row frame as a struct-valued scalar subquery."""
    return df.select(F.struct(*columns)).scalar()


def metrics_document(
    regression: DataFrame, auc: DataFrame, report: DataFrame, sizes: dict[str, tuple[int, int]],
    reg_target: str = "patient_star_avg", clf_target: str = "is_underperformer",
) -> DataFrame:
    """``regression``: (r2, mae); ``auc``: (roc_auc); ``report``: rows of ``classification_report``."""
    spark = regression.sparkSession
    reg = _row(regression, "r2", "mae")
    per_class = report.filter(F.col("class") != "accuracy").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("class", F.struct("precision", "recall", "f1_score", "support"))))
        )
    ).scalar()
    accuracy = report.filter(F.col("class") == "accuracy").select("f1_score").scalar()
    n = {k: (F.lit(a).cast("long"), F.lit(b).cast("long")) for k, (a, b) in sizes.items()}
    return spark.range(1).select(
        F.struct(
            F.lit(reg_target).alias("target"), n["regression"][0].alias("n_train"), n["regression"][1].alias("n_test"),
            reg["r2"].alias("r2"), reg["mae"].alias("mae_stars"),
        ).alias("regression"),
        F.struct(
            F.lit(clf_target).alias("target"), n["classification"][0].alias("n_train"),
            n["classification"][1].alias("n_test"), auc.select("roc_auc").scalar().alias("roc_auc"),
            accuracy.alias("accuracy"), per_class.alias("report"),
        ).alias("classification"),
    )

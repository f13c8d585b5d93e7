"""Model quality as aggregates over scored rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.rounding import half_even
from wardlens.operators.ranking import running_total

THRESHOLD = 0.5


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 3) -> DataFrame:
    """R2 and mean absolute error in one pass. A constant label gives R2 1 when met exactly, else 0."""
    error = F.col(label) - F.col(prediction)
    sums = df.agg(
        F.count("*").alias("n"),
        F.sum(error * error).alias("_sse"),
        (F.var_pop(label) * F.count(label)).alias("_sst"),
        F.avg(F.abs(error)).alias("_mae"),
    )
    flat = F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_sst") == 0, flat).otherwise(1 - F.try_divide("_sse", "_sst"))
    return sums.select("n", half_even(r2, digits).alias("r2"), half_even("_mae", digits).alias("mae"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", digits: int = 6) -> DataFrame:
    """Area under the ROC curve; rows with equal scores count half.

    Rows shrink to one per distinct score first. NULL when a class is absent.
    """
    positive = F.count_if(F.col(label) == 1)
    per_score = df.groupBy(score).agg(positive.alias("_pos"), (F.count("*") - positive).alias("_neg"))
    below = running_total(per_score, [(score, "asc")], "_neg", "_neg_below")
    won = F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0))
    return below.agg(won.alias("_won"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives")).select(
        half_even(F.try_divide(F.col("_won"), F.col("positives").cast("double") * F.col("negatives")), digits).alias(
            "roc_auc"
        ),
        "positives",
        "negatives",
    )


def _share(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def class_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, f1 and support per class; 0 where a share is undefined."""
    pairs = df.groupBy(F.col(label).cast("int").alias("y"), F.col(predicted).cast("int").alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    roles = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), hit.alias("hits")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    sums = roles.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("support", "said", "hits")])
    precision = _share(F.col("hits"), F.col("said"))
    recall = _share(F.col("hits"), F.col("support"))
    return sums.select(
        F.col("c").cast("string").alias("class"),
        precision.alias("precision"),
        recall.alias("recall"),
        _share(2 * precision * recall, precision + recall).alias("f1_score"),
        "support",
        "hits",
    )


def classification_report(
    df: DataFrame, label: str = "label", score: str = "score", threshold: float = THRESHOLD, digits: int = 6
) -> DataFrame:
    """Per-class rows, then accuracy (as f1), macro and support-weighted means."""
    classes = class_report(df.withColumn("predicted", (F.col(score) >= threshold).cast("int")), label, "predicted")
    shares = ("precision", "recall", "f1_score")
    total = F.sum("support")
    none = F.lit(None).cast("double")
    rows = [
        classes.drop("hits"),
        classes.agg(_share(F.sum("hits"), total).alias("f1_score"), total.alias("support")).select(
            F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"), "f1_score", "support"
        ),
        classes.agg(*[F.avg(c).alias(c) for c in shares], total.alias("support")).select(
            F.lit("macro avg").alias("class"), *shares, "support"
        ),
        classes.agg(
            *[_share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in shares], total.alias("support")
        ).select(F.lit("weighted avg").alias("class"), *shares, "support"),
    ]
    report = reduce(DataFrame.unionByName, rows)
    return report.select("class", *[half_even(c, digits).alias(c) for c in shares], "support")

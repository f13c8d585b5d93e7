"""Text tables to clean tables: parsed once, stored as Parquet, laid out for the catalogue's filters.

A clean table keeps every text column and adds typed companions, named after the column:
``score__double``, ``overall_rating__int``, ``measure_id__key``. The catalogue uses a
companion when it is there, so the same query runs on text and on clean tables. On clean
tables its number and text filters are plain comparisons, which reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.clean import fold, num, rating

_COUNTS = tuple(
    f"count_{group}_measures_{kind}" for group in ("mort", "safety", "readm") for kind in ("better", "no_different", "worse")
)

# Per table: number companions (column, kind), text keys, and the order rows are stored in.
NUMBERS = {
    "general": (("overall_rating", "int"), *((c, "int") for c in _COUNTS)),
    "timely": (("score", "double"),),
    "survey": (
        ("patient_survey_star_rating", "double"),
        ("survey_response_rate_percent", "int"),
        ("survey_response_rate_percent", "double"),
        ("hcahps_answer_percent", "double"),
        ("number_of_completed_surveys", "int"),
    ),
}
KEYS = {
    "general": ("state", "county_parish", "hospital_type", "hospital_ownership", "emergency_services", "birthing_friendly"),
    "timely": ("facility_name", "condition_name", "measure_id"),
    "survey": ("facility_name", "hcahps_measure_id"),
}
STORED_BY = {
    "general": ("state__key",),
    "timely": ("measure_id__key", "condition_name__key"),
    "survey": ("hcahps_measure_id__key",),
}


def with_companions(df: DataFrame, table: str) -> DataFrame:
    """Add the typed companions of one of the tables general, timely, survey."""
    added = {f"{c}__{kind}": num(c, kind) for c, kind in NUMBERS[table]}
    added |= {f"{c}__key": fold(c) for c in KEYS[table]}
    if table == "general":
        added["overall_rating__rating"] = rating()
    return df.withColumns(added)


def write_clean(df: DataFrame, table: str, path: str) -> None:
    """Store a clean table, one folder per release when rows carry a ``period``.

    Rows are sorted by the filter keys inside each task, so row groups of other measures
    are skipped by their statistics. There is no shuffle: the scan's tasks write their rows.
    """
    clean = with_companions(df, table)
    period = ["period"] if "period" in df.columns else []
    ordered = clean.sortWithinPartitions(*[F.col(c) for c in (*period, *STORED_BY[table])])
    writer = ordered.write.mode("overwrite")
    (writer.partitionBy(*period) if period else writer).parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """A clean table; a release label stays text."""
    df = spark.read.parquet(path)
    return df.withColumn("period", F.col("period").cast("string")) if "period" in df.columns else df

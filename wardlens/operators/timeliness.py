"""Process-of-care measures by condition (q46-q60). ``t`` is long: hospital x measure x period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.clean import NOT_AVAILABLE, fold, num, number, text_is
from wardlens.functions.periods import parse_date
from wardlens.functions.rounding import half_up
from wardlens.operators.grouping import mean_by, mean_parts, merge_spellings, merged_mean, same_label, text_mean_by
from wardlens.operators.ranking import ntile_rows, number_rows, sort_rows
from wardlens.sources.scratch import materialize


def scored(t: DataFrame) -> DataFrame:
    """Rows with a numeric score, as ``_score``. Minute-based measures stay in."""
    return t.withColumn("_score", number(t, "score")).filter(F.col("_score").isNotNull())


def measures_for(t: DataFrame, name: str = "SOUTHEAST HEALTH MEDICAL CENTER") -> DataFrame:
    rows = t.filter(text_is(t, "facility_name", name)).select("facility_name", "measure_name", "score")
    return sort_rows(rows, "measure_name")


def condition_records(t: DataFrame, condition: str = "Emergency Department") -> DataFrame:
    rows = scored(t.filter(text_is(t, "condition_name", condition)))
    ordered = sort_rows(rows, F.desc("_score"), F.asc("facility_name"), F.asc("measure_name"))
    return ordered.select("facility_name", "state", "condition_name", "measure_name", "score")


def perfect_scores(t: DataFrame, condition: str = "Healthcare Personnel Vaccination", score: float = 100.0) -> DataFrame:
    rows = t.filter(text_is(t, "condition_name", condition) & (number(t, "score") == score))
    return sort_rows(rows.select("facility_name", "state", "measure_name", "score"), "facility_name")


def missing_scores(t: DataFrame, measure: str = "OP_23") -> DataFrame:
    """Score absent or written as the missing word; an empty text is neither."""
    absent = F.col("score").isNull() | text_is(t, "score", NOT_AVAILABLE)
    rows = t.filter(text_is(t, "measure_id", measure) & absent)
    return sort_rows(rows.select("facility_name", "state", "measure_name", "score"), "state", "facility_name")


def avg_score_by(t: DataFrame, by: str, lowest_first: bool = False) -> DataFrame:
    means = text_mean_by(scored(t), [by], "_score", "_mean").select(by, half_up("_mean", 2).alias("average_score"))
    order = F.asc("average_score") if lowest_first else F.desc("average_score")
    return means.orderBy(order, by)


def reporters_per_measure(t: DataFrame, approximate: bool = False) -> DataFrame:
    """Hospitals that report a measure. The distinct count runs in two steps, (measure, hospital)
    then measure, so a measure most hospitals report is spread over tasks.
    ``approximate`` trades exactness for one step with a fixed-size sketch."""
    reported = t.filter(fold("score") != NOT_AVAILABLE.lower())
    count = F.approx_count_distinct("facility_id") if approximate else F.countDistinct("facility_id")
    return (
        reported.groupBy("measure_id").agg(count.alias("total_hospitals")).orderBy(F.desc("total_hospitals"), "measure_id")
    )


def _state_means(parts: DataFrame, h: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("_sum", "_n")]
    states = parts.join(h.select("facility_id", "state"), "facility_id").groupBy("state").agg(*sums)
    merged = merge_spellings(states, ["state"], [], ["_sum", "_n"])
    return merged.select("state", F.try_divide("_sum", "_n").alias("_mean"))


def avg_score_by_state(t: DataFrame, h: DataFrame, condition: str = "Emergency Department") -> DataFrame:
    parts = mean_parts(scored(t.filter(text_is(t, "condition_name", condition))), ["facility_id"], "_score")
    return (
        _state_means(parts, h)
        .select("state", half_up("_mean", 2).alias("average_score"))
        .orderBy(F.desc("average_score"), "state")
    )


def states_below_national(t: DataFrame, h: DataFrame, measure: str = "IMM_3") -> DataFrame:
    """States whose mean is below the mean over all scored rows of the measure.

    The national mean is taken before the join, from the same per-hospital sums; they are
    written once, so the long table is read once.
    """
    parts = mean_parts(scored(t.filter(text_is(t, "measure_id", measure))), ["facility_id"], "_score")
    parts = materialize(parts, "parts")
    national = parts.agg(merged_mean()).scalar()
    return (
        _state_means(parts, h)
        .filter(F.col("_mean") < national)
        .select("state", half_up("_mean", 2).alias("state_average"))
        .orderBy("state_average", "state")
    )


def rank_in_state(t: DataFrame, h: DataFrame, measure: str = "IMM_3") -> DataFrame:
    """Row number within the state by score, best first; ties by name, then id."""
    rows = scored(t.filter(text_is(t, "measure_id", measure))).select("facility_id", "facility_name", "measure_id", "_score")
    joined = rows.join(h.select("facility_id", "state"), "facility_id")
    joined = joined.withColumn("_state", fold("state"))
    ranked = number_rows(joined, [("_score", "desc")], ["facility_name", "facility_id"], ["_state"], "state_rank")
    return ranked.select(
        "state", "facility_name", "measure_id", F.col("_score").alias("score"), "state_rank"
    ).orderBy(fold("state"), "state_rank")


def v_timely_summary(t: DataFrame, h: DataFrame) -> DataFrame:
    """Every score row with the state and owner of its hospital."""
    return t.select(
        "facility_id", "facility_name", "condition_name", "measure_id", "measure_name", "score", "start_date", "end_date"
    ).join(h.select("facility_id", "state", "hospital_ownership"), "facility_id").select(
        "facility_id", "facility_name", "state", "hospital_ownership", "condition_name",
        "measure_id", "measure_name", "score", "start_date", "end_date",
    )


def flag_bottom(t: DataFrame, measure: str = "IMM_3", tiles: int = 10) -> DataFrame:
    """Lowest tile nationally on a measure marked; ties by id."""
    rows = scored(t.filter(text_is(t, "measure_id", measure))).select("facility_id", "facility_name", "state", "_score")
    tiled = ntile_rows(rows, tiles, [("_score", "asc")], ["facility_id"], "risk_group")
    label = F.when(F.col("risk_group") == 1, f"Bottom {100 // tiles}%").otherwise("Other")
    shown = tiled.select("facility_name", "state", F.col("_score").alias("score"), label.alias("performance"))
    return sort_rows(shown, "score", "facility_name")


def change_over_time(df: DataFrame, within: list[str], value: str, previous: str, change: str) -> DataFrame:
    """Previous value and difference in date order. ``df`` holds one row per group and period,
    so a group is as long as the calendar allows."""
    w = Window.partitionBy(*within).orderBy(*_by_date())
    return df.withColumn(previous, F.lag(value).over(w)).withColumn(change, F.col(value) - F.col(previous))


def _by_date() -> list[Column]:
    return [
        parse_date("start_date").asc_nulls_first(),
        parse_date("end_date").asc_nulls_first(),
        F.asc("start_date"),
        F.asc("end_date"),
    ]


def score_change(t: DataFrame) -> DataFrame:
    means = text_mean_by(scored(t), ["condition_name"], "_score", "avg_score", ["start_date", "end_date"])
    means = same_label(means, "condition_name").select("condition_name", "start_date", "end_date", "avg_score")
    return change_over_time(means, ["condition_name"], "avg_score", "previous_score", "score_change").orderBy(
        "condition_name", *_by_date()
    )


def timely_by_rating(t: DataFrame, h: DataFrame) -> DataFrame:
    parts = mean_parts(scored(t), ["facility_id"], "_score")
    tiers = h.filter(number(h, "overall_rating", "int").isNotNull()).select("facility_id", "overall_rating")
    return (
        parts.join(tiers, "facility_id")
        .groupBy("overall_rating")
        .agg(merged_mean().alias("avg_timely_score"))
        .orderBy(num("overall_rating", "int"))
    )


def timely_mean_all(t: DataFrame, out: str = "avg_timely_score") -> DataFrame:
    """Mean of every numeric score per hospital."""
    return mean_by(scored(t), ["facility_id"], F.col("_score"), out)


def timely_mean_0_100(t: DataFrame, out: str = "timely_care_avg", keys: tuple[str, ...] = ("facility_id",)) -> DataFrame:
    """Mean of the scores from 0 to 100 per hospital; minute counts above 100 are left out."""
    return mean_by(scored(t).filter(F.col("_score").between(0, 100)), list(keys), F.col("_score"), out)

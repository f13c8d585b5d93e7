"""One clean row per hospital (and release): general record, survey and timely-care means, labels.

Input frames carry the published headings or the snake-case table columns. With
``keys=PER_RELEASE`` everything is done per release, by a ``period`` column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.clean import pick, row_sum0, strip, to_num, underperformer_flag, yes_flag
from wardlens.operators.ranking import top_n_within
from wardlens.sources.schemas import GENERAL_FIELDS, SURVEY_FIELDS, TIMELY_FIELDS

WORSE = ("_mort_worse", "_safety_worse", "_readm_worse")


ONE_RELEASE = ("facility_id",)
PER_RELEASE = ("period", "facility_id")


def _period(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    return [df["period"]] if "period" in keys else []


def _field(df: DataFrame, fields: dict[str, tuple[str, ...]], name: str) -> Column:
    return pick(df, *fields[name], name)


def load_general(df: DataFrame, keys: Sequence[str] = ONE_RELEASE) -> DataFrame:
    """Typed hospital record; of repeated ids the first in file order stays (``row_seq``).

    Without ``row_seq`` the smallest record stays, compared column by column. A blank id is no id.
    """

    def text(name: str) -> Column:
        return strip(_field(df, GENERAL_FIELDS, name))

    has_county = any(c in df.columns for c in (*GENERAL_FIELDS["county_parish"], "county_parish"))
    in_file = df["row_seq"] if "row_seq" in df.columns else F.struct(*[df[f"`{c}`"] for c in df.columns])
    order = [in_file.alias("_seq")]
    rows = df.select(
        *_period(df, keys),
        *order,
        F.nullif(text("facility_id"), F.lit("")).alias("facility_id"),
        text("facility_name").alias("facility_name"),
        text("state").alias("state"),
        (text("county_parish") if has_county else F.lit("")).alias("county"),
        text("hospital_type").alias("hospital_type"),
        text("hospital_ownership").alias("hospital_ownership"),
        yes_flag(_field(df, GENERAL_FIELDS, "emergency_services")).alias("emergency_services"),
        to_num(_field(df, GENERAL_FIELDS, "overall_rating")).alias("overall_rating"),
        to_num(_field(df, GENERAL_FIELDS, "count_mort_measures_worse")).alias("_mort_worse"),
        to_num(_field(df, GENERAL_FIELDS, "count_safety_measures_worse")).alias("_safety_worse"),
        to_num(_field(df, GENERAL_FIELDS, "count_readm_measures_worse")).alias("_readm_worse"),
    )
    return top_n_within(rows, list(keys), [F.asc("_seq")], 1, "_rn").drop("_seq", "_rn")


def _long(df: DataFrame, keys: Sequence[str], fields: dict[str, tuple[str, ...]], **values: str) -> DataFrame:
    """Key columns and numeric values of a long table; rows without an id go."""
    rows = df.select(
        *_period(df, keys),
        F.nullif(strip(_field(df, fields, "facility_id")), F.lit("")).alias("facility_id"),
        *[to_num(_field(df, fields, source)).alias(out) for out, source in values.items()],
    )
    return rows.filter(F.col("facility_id").isNotNull())


def load_hcahps(df: DataFrame, keys: Sequence[str] = ONE_RELEASE) -> DataFrame:
    """Mean star, best response rate and most completed surveys per hospital."""
    rows = _long(
        df, keys, SURVEY_FIELDS,
        star="patient_survey_star_rating", rate="survey_response_rate_percent", done="number_of_completed_surveys",
    )
    return rows.groupBy(*keys).agg(
        F.avg("star").alias("patient_star_avg"),
        F.max("rate").alias("survey_response_rate"),
        F.max("done").alias("completed_surveys"),
    )


def load_timely(df: DataFrame, keys: Sequence[str] = ONE_RELEASE) -> DataFrame:
    """Mean of the scores from 0 to 100 per hospital."""
    rows = _long(df, keys, TIMELY_FIELDS, points="score").filter(F.col("points").between(0, 100))
    return rows.groupBy(*keys).agg(F.avg("points").alias("timely_care_avg"))


def with_targets(df: DataFrame) -> DataFrame:
    """Composite risk and label.

    A release in which no hospital has any worse count has an unknown composite; the
    label still takes missing counts as 0. Which releases have counts is read from the
    data, as a scalar subquery with one label per release.
    """
    total = row_sum0(list(WORSE))
    any_count = F.coalesce(*[F.col(c) for c in WORSE]).isNotNull()
    if "period" in df.columns:
        known = df.filter(any_count).agg(F.collect_set("period")).scalar()
        has_counts = F.array_contains(known, F.col("period"))
    else:
        has_counts = F.coalesce(df.agg(F.bool_or(any_count)).scalar(), F.lit(False))
    return df.withColumns(
        {
            "composite_risk_score": F.when(has_counts, total).cast("double"),
            "is_underperformer": underperformer_flag("overall_rating", total),
        }
    )


def assemble(
    general: DataFrame, hcahps: DataFrame, timely: DataFrame, keys: Sequence[str] = ONE_RELEASE
) -> DataFrame:
    """Feature table: every hospital of the general file, with what the other two know."""
    return with_targets(general.join(hcahps, list(keys), "left").join(timely, list(keys), "left"))

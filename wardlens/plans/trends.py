"""Trend signals from the panel: slopes, early warning, national means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.periods import period_index
from wardlens.functions.rounding import half_even
from wardlens.plans.panel import METRICS

SATISFACTION_DECLINE = -0.03  # stars per release
RISK_RISE = 0.05  # worse measures per release
INDEXED = ("patient_star_avg", "timely_care_avg", "overall_rating")


def slope(y: str, t: str = "t") -> Column:
    """Least-squares slope over the non-null points; NULL below two points."""
    return F.when(F.count(y) >= 2, F.regr_slope(y, t))


def latest(columns: Sequence[str], order: str = "period") -> Column:
    """Values of the last row as one struct; a NULL in that row stays NULL."""
    return F.max_by(F.struct(*columns), order)


def _trajectories(panel: DataFrame) -> DataFrame:
    """One row per hospital from a single shuffle: raw slopes and latest name and state."""
    return (
        period_index(panel)
        .groupBy("facility_id")
        .agg(
            slope("patient_star_avg").alias("_sat"),
            slope("composite_risk_score").alias("_risk"),
            latest(["facility_name", "state"]).alias("_last"),
        )
    )


def slopes(panel: DataFrame) -> DataFrame:
    return (
        period_index(panel)
        .groupBy("facility_id")
        .agg(
            half_even(slope("patient_star_avg"), 4).alias("satisfaction_slope"),
            half_even(slope("composite_risk_score"), 4).alias("risk_slope"),
        )
    )


def latest_attrs(panel: DataFrame) -> DataFrame:
    return (
        panel.groupBy("facility_id")
        .agg(latest(["facility_name", "state"]).alias("_last"))
        .select("facility_id", "_last.facility_name", "_last.state")
    )


def early_warning(panel: DataFrame, satisfaction: float = SATISFACTION_DECLINE, risk: float = RISK_RISE) -> DataFrame:
    """Hospitals with their slopes; flagged when satisfaction falls or risk rises fast enough."""
    return warned(_trajectories(panel), satisfaction, risk)


def warned(lines: DataFrame, satisfaction: float, risk: float) -> DataFrame:
    """Flags for rows of ``facility_id``, raw slopes ``_sat`` and ``_risk``, and last row ``_last``.

    The limits apply to the slopes with nine decimals: unrounded in effect, but a slope that
    equals a limit does not pass it by the last bit of a double. Hospitals without a slope
    come last.
    """
    falling = F.coalesce(half_even("_sat", 9) < satisfaction, F.lit(False))
    rising = F.coalesce(half_even("_risk", 9) > risk, F.lit(False))
    return (
        lines.select(
            "facility_id",
            "_last.facility_name",
            "_last.state",
            half_even("_sat", 4).alias("satisfaction_slope"),
            half_even("_risk", 4).alias("risk_slope"),
            (falling | rising).cast("int").alias("declining_trajectory"),
        )
        .orderBy(F.asc_nulls_last("satisfaction_slope"), "facility_id")
    )


def national_trends(panel: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of every metric per release, three decimals, in release order."""
    present = [m for m in metrics if m in panel.columns]
    return panel.groupBy("period").agg(*[half_even(F.avg(m), 3).alias(m) for m in present]).orderBy("period")


def indexed_trends(national: DataFrame, metrics: Sequence[str] = INDEXED) -> DataFrame:
    """Each metric with its value in the first release set to 100."""
    present = [m for m in metrics if m in national.columns]
    first = national.agg(F.min_by(F.struct(*present), "period").alias("first")).scalar()
    return national.select(
        "period", *[half_even(F.try_divide(F.col(m), first[m]) * 100, 6).alias(m) for m in present]
    ).orderBy("period")

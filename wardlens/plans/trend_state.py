"""Trend signals kept up to date release by release, without reading old releases again.

The state has two small tables. ``hospitals`` holds, per hospital and tracked metric, the sums a
least-squares line needs (number of points, of t, y, t*t and t*y), and the hospital's last row.
``releases`` holds, per release, its place t and the sum and count of every metric. Both are merged
by adding sums and taking the later row, so states of parts can be merged in any order and a new
release costs one shuffle of that release and of the state.

Places follow the order of release labels. A release that is not later than all known ones would move
the places of others: it is refused, and the state has to be built anew from the panel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.periods import period_index
from wardlens.functions.rounding import half_even
from wardlens.plans.panel import METRICS
from wardlens.plans.trends import RISK_RISE, SATISFACTION_DECLINE, warned
from wardlens.sources.sinks import write_table

TRACKED = {"sat": "patient_star_avg", "risk": "composite_risk_score"}
_SUMS = ("n", "t", "y", "tt", "ty")


class TrendState(NamedTuple):
    hospitals: DataFrame
    releases: DataFrame


def _line_sums(metric: str, name: str) -> list[Column]:
    """The sums over the rows in which the metric is known."""
    y = F.when(F.col("t").isNotNull(), F.col(metric))
    t = F.when(y.isNotNull(), F.col("t").cast("long"))
    found = {"n": F.count(y), "t": F.sum(t), "y": F.sum(y), "tt": F.sum(t * t), "ty": F.sum(t * y)}
    return [F.coalesce(found[k], F.lit(0)).alias(f"{name}_{k}") for k in _SUMS]


def _last(columns: Sequence[str]) -> Column:
    return F.max_by(F.struct("period", *columns), "period").alias("last")


def _with_metrics(rows: DataFrame) -> DataFrame:
    """All metrics as doubles; one the release does not have is NULL."""
    return rows.withColumns({m: (F.col(m) if m in rows.columns else F.lit(None)).cast("double") for m in METRICS})


def _summed(rows: DataFrame) -> TrendState:
    rows = _with_metrics(rows)
    lines = [c for name, metric in TRACKED.items() for c in _line_sums(metric, name)]
    hospitals = rows.groupBy("facility_id").agg(*lines, _last(["facility_name", "state", *METRICS]))
    totals = [c for m in METRICS for c in (F.count(m).alias(f"{m}_n"), F.coalesce(F.sum(m), F.lit(0.0)).alias(f"{m}_sum"))]
    return TrendState(hospitals, rows.groupBy("period", "t").agg(*totals))


def from_panel(panel: DataFrame) -> TrendState:
    """State of all releases of a panel."""
    return _summed(period_index(panel))


def merge(states: Sequence[TrendState]) -> TrendState:
    """State of the rows of all given states; their places must follow one order of releases."""
    hospitals, releases = (reduce(DataFrame.unionByName, tables) for tables in zip(*states))
    sums = [f"{name}_{k}" for name in TRACKED for k in _SUMS]
    last = F.max_by("last", "last.period").alias("last")
    totals = [f"{m}_{k}" for m in METRICS for k in ("n", "sum")]
    return TrendState(
        hospitals.groupBy("facility_id").agg(*[F.sum(c).alias(c) for c in sums], last),
        releases.groupBy("period", "t").agg(*[F.sum(c).alias(c) for c in totals]),
    )


def add_release(state: TrendState, release: DataFrame, period: str) -> TrendState:
    """State with one later release (a feature table without label); old releases are not read."""
    known = state.releases.agg(F.max("period").alias("newest"), F.max("t").alias("t")).first()
    if known["newest"] is not None and period <= known["newest"]:
        raise ValueError(f"release {period} is not later than {known['newest']}; build the state anew")
    place = 0 if known["t"] is None else known["t"] + 1
    labelled = release.withColumns({"period": F.lit(period), "t": F.lit(place)})
    return merge([state, _summed(labelled)])


def release_deltas(state: TrendState, release: DataFrame) -> DataFrame:
    """Change of a new release, one row per hospital, against each hospital's last row in the state."""
    present = [m for m in METRICS if m in release.columns]
    past = state.hospitals.select(F.col("facility_id").alias("_id"), *[F.col(f"last.{m}").alias(f"_past_{m}") for m in present])
    moved = release.join(past, F.col("facility_id").eqNullSafe(F.col("_id")), "left")
    changes = {f"{m}_delta": F.col(m) - F.col(f"_past_{m}") for m in present}
    return moved.withColumns(changes).drop("_id", *[f"_past_{m}" for m in present])


def _slope(name: str) -> Column:
    """Slope of the line from its sums; NULL below two points or with all points in one release."""
    n, t, y, tt, ty = (F.col(f"{name}_{k}") for k in _SUMS)
    return F.when(n >= 2, F.try_divide(n * ty - t * y, n * tt - t * t))


def early_warning(state: TrendState, satisfaction: float = SATISFACTION_DECLINE, risk: float = RISK_RISE) -> DataFrame:
    """As ``trends.early_warning``, from the state alone."""
    lines = state.hospitals.select(
        "facility_id", _slope("sat").alias("_sat"), _slope("risk").alias("_risk"), F.col("last").alias("_last")
    )
    return warned(lines, satisfaction, risk)


def national_trends(state: TrendState) -> DataFrame:
    """As ``trends.national_trends``, from the state alone."""
    means = [half_even(F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_n")), 3).alias(m) for m in METRICS]
    return state.releases.select("period", *means).orderBy("period")


def write(state: TrendState, path: str) -> None:
    """Store the state in a new folder; a state is never written over the one it was made from."""
    write_table(state.hospitals, f"{path}/hospitals")
    write_table(state.releases, f"{path}/releases")


def read(spark: SparkSession, path: str) -> TrendState:
    return TrendState(spark.read.parquet(f"{path}/hospitals"), spark.read.parquet(f"{path}/releases"))

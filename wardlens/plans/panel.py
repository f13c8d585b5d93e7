"""Hospital x release panel and its release-to-release changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.sources.snapshots import stack

METRICS = ("patient_star_avg", "survey_response_rate", "timely_care_avg", "overall_rating", "composite_risk_score")


def add_deltas(panel: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Change against the hospital's previous row, for the metrics the panel has.

    Gaps are not filled. A hospital has one row per release, so its window is as
    short as the release list. All metrics share one shuffle and one sort.
    """
    w = Window.partitionBy("facility_id").orderBy("period")
    present = [m for m in metrics if m in panel.columns]
    return panel.withColumns({f"{m}_delta": F.col(m) - F.lag(m).over(w) for m in present})


def build_panel(frames: list[DataFrame]) -> DataFrame:
    """Stack the releases and add the changes. No frames is an error."""
    return add_deltas(stack(frames))

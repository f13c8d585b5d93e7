"""Mortality, safety and readmission outcomes (q31-q45)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.functions.clean import BETTER_COUNTS, WORSE_COUNTS, better, composite_risk, fold, num, number, worse
from wardlens.functions.rounding import half_up
from wardlens.operators.grouping import mean_by, merge_spellings, text_mean_by
from wardlens.operators.ranking import ntile_rows, rank_by_value, sort_rows, top_n_within

_ALL_WORSE = list(WORSE_COUNTS.values())


def worse_counts(h: DataFrame) -> DataFrame:
    rows = h.select("facility_name", "state", WORSE_COUNTS["mort"], WORSE_COUNTS["safety"])
    return sort_rows(rows, "facility_name")


def _counted(h: DataFrame, keep: Column, column: str) -> DataFrame:
    return h.filter(keep).select("facility_name", "city_town", "state", column)


def worse_gt(h: DataFrame, group: str = "readm", more_than: int = 0) -> DataFrame:
    """Largest counts first, in number order."""
    rows = _counted(h, worse(group, h) > more_than, WORSE_COUNTS[group])
    return sort_rows(rows, num(WORSE_COUNTS[group], "int").desc(), F.asc("facility_name"))


def worse_eq(h: DataFrame, group: str = "mort", value: int = 0) -> DataFrame:
    return sort_rows(_counted(h, worse(group, h) == value, WORSE_COUNTS[group]), "state", "facility_name")


def better_gt(h: DataFrame, group: str = "safety", more_than: int = 2) -> DataFrame:
    """Largest counts first, in number order."""
    rows = _counted(h, better(group, h) > more_than, BETTER_COUNTS[group])
    return sort_rows(rows, num(BETTER_COUNTS[group], "int").desc(), F.asc("facility_name"))


def all_zero(h: DataFrame) -> DataFrame:
    """No worse measure in any group; a missing count is not zero."""
    zero = h.filter((worse("mort", h) == 0) & (worse("safety", h) == 0) & (worse("readm", h) == 0))
    return sort_rows(zero.select("facility_name", "city_town", "state", *_ALL_WORSE), "facility_name")


def avg_worse_by(h: DataFrame, group: str, by: str, out: str) -> DataFrame:
    means = text_mean_by(h, [by], worse(group, h).cast("double"), "_mean")
    return means.select(by, half_up("_mean", 2).alias(out)).orderBy(F.desc_nulls_last(out), by)


def avg_worse_by_rating(h: DataFrame, group: str = "safety") -> DataFrame:
    tiers = h.filter(number(h, "overall_rating", "int").isNotNull())
    means = mean_by(tiers, ["overall_rating"], worse(group, h).cast("double"), "_mean")
    return means.select("overall_rating", half_up("_mean", 2).alias("avg_safety_measures_worse")).orderBy(
        num("overall_rating", "int")
    )


def rank_by_composite(h: DataFrame) -> DataFrame:
    """National rank by composite risk. The score is a small whole number, so ranks come from value counts."""
    scored = h.select("facility_name", "state", *_ALL_WORSE, composite_risk(h).cast("long").alias("total_risk_score"))
    ranked = rank_by_value(scored, "total_risk_score", "desc", "national_rank")
    shown = ranked.select("facility_name", "state", *_ALL_WORSE, "total_risk_score", "national_rank")
    return sort_rows(shown, "national_rank", "facility_name")


def high_risk_by_state(h: DataFrame, tiles: int = 10, text_order: bool = False) -> DataFrame:
    """Hospitals of the worst tile by composite risk, counted per state; ties by id.

    ``text_order`` orders by the three counts written one after another, as text.
    """
    key = F.concat(*_ALL_WORSE) if text_order else composite_risk(h)
    scored = h.select("facility_id", "state", key.alias("_risk"))
    tiled = ntile_rows(scored, tiles, [("_risk", "desc")], ["facility_id"], "risk_group")
    counts = tiled.filter(F.col("risk_group") == 1).groupBy("state").agg(F.count("*").alias("high_risk_hospitals"))
    merged = merge_spellings(counts, ["state"], [], ["high_risk_hospitals"])
    return merged.orderBy(F.desc("high_risk_hospitals"), "state")


def v_risk_summary(h: DataFrame) -> DataFrame:
    """Composite risk per hospital, next to the counts it is made of."""
    return h.select(
        "facility_id", "facility_name", "state", *_ALL_WORSE, composite_risk(h).cast("long").alias("composite_risk_score")
    )


def worst_per_state(h: DataFrame) -> DataFrame:
    """Highest composite risk per state among hospitals with any count; ties by name, then id."""
    known = worse("mort", h).isNotNull() | worse("safety", h).isNotNull() | worse("readm", h).isNotNull()
    scored = h.filter(known).select(
        "facility_id", "facility_name", "state", composite_risk(h).cast("long").alias("risk_score")
    )
    order = [F.desc("risk_score"), F.asc("facility_name"), F.asc("facility_id")]
    worst = top_n_within(scored, [fold("state")], order, 1)
    return worst.select("state", "facility_name", "risk_score").orderBy("state")


def above_national(h: DataFrame, group: str = "safety", margin: float = 0.0) -> DataFrame:
    """Hospitals whose worse count is above the national mean by more than ``margin``."""
    count = worse(group, h)
    national = h.agg(F.avg(count.cast("double"))).scalar()
    rows = h.filter(count > national + F.lit(margin)).select("facility_name", "state", WORSE_COUNTS[group])
    return sort_rows(rows, num(WORSE_COUNTS[group], "int").desc(), F.asc("facility_name"))

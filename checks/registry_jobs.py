"""Registered jobs other than the catalogue: profiling, scalar rules, features, panel, trends, evaluation, triage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.provider_tables import provider
from wardlens.functions import clean, periods, rounding
from wardlens.models import documents, metrics, triage
from wardlens.operators.timeliness import timely_mean_all, timely_mean_0_100
from wardlens.plans import features, panel, training_extract, trend_state, trends
from wardlens.sources import profiling, snapshots
from wardlens.sources.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def on(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    def bind(fn: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: fn(*[provider(spark, sf_dir, n) for n in names])

    return bind


# --- profiling -------------------------------------------------------------------

# Published column names.
CATEGORIES = ("birthing_friendly", "emergency_services", "overall_rating", "hospital_type", "hospital_ownership")


def _row_counts(h: DataFrame, t: DataFrame, s: DataFrame) -> DataFrame:
    return profiling.row_counts({"hospital_general_info": h, "timely_effective_care": t, "hcahps_survey": s})


def release_panel(snap: DataFrame) -> DataFrame:
    """Derived snapshots with composite risk and label, as one panel."""
    return features.with_targets(snap)


PROFILING = {
    "prof_lengths": on("facility")(
        lambda h: profiling.max_lengths(h.drop("row_seq"))
    ),
    "prof_rowcounts": on("facility", "timely", "survey")(_row_counts),
    "prof_distinct": on("facility")(lambda h: profiling.distinct_of(h, CATEGORIES)),
    "prof_coverage": on("snapshot")(lambda x: profiling.coverage(release_panel(x))),
    "prof_balance": on("snapshot")(lambda x: profiling.balance(release_panel(x), "is_underperformer")),
    "prof_panel": on("snapshot")(lambda x: profiling.panel_summary(release_panel(x))),
}

# --- scalar rules ----------------------------------------------------------------


def _try_cast(h: DataFrame) -> DataFrame:
    return h.select(
        "facility_id",
        clean.num("overall_rating", "int").alias("as_int"),
        clean.num("count_mort_measures_worse", "double").alias("as_double"),
        clean.rating().alias("as_rating"),
    )


def _guarded_cast(h: DataFrame) -> DataFrame:
    known = h.filter(~clean.is_missing("overall_rating"))
    return known.select("facility_id", F.col("overall_rating").try_cast("int").alias("stars"))


def _to_num(t: DataFrame) -> DataFrame:
    return t.select("facility_id", "measure_id", "score", clean.to_num("score").alias("points"))


def _pick(h: DataFrame) -> DataFrame:
    return h.select(
        "facility_id",
        clean.pick(h, "County/Parish", "County Name", "county_parish").alias("county"),
        clean.pick_num(h, "count_mort_measures_worse").alias("worse"),
        clean.pick(h, "no_such_column").alias("absent"),
    )


def _isnull(h: DataFrame) -> DataFrame:
    return h.select("facility_id", clean.zero_if_null(clean.worse("readm")).alias("readm_worse"))


def _row_sum(x: DataFrame) -> DataFrame:
    return x.select("facility_id", "period", clean.row_sum0(list(features.WORSE)).alias("worse_total"))


def _trim(h: DataFrame) -> DataFrame:
    padded = h.select("facility_id", F.concat(F.lit("  "), "facility_name", F.lit(" \t")).alias("padded"))
    return padded.select("facility_id", clean.strip("padded").alias("facility_name"))


def _flags(x: DataFrame) -> DataFrame:
    total = clean.row_sum0(list(features.WORSE))
    return x.select("facility_id", "period", clean.underperformer_flag("overall_rating", total).alias("is_underperformer"))


def _case(h: DataFrame) -> DataFrame:
    worse = clean.worse("mort")
    label = F.when(worse >= 2, "several").when(worse == 1, "one").when(worse == 0, "none").otherwise("unknown")
    return h.groupBy(label.alias("mortality")).agg(F.count("*").alias("hospitals"))


def _between(t: DataFrame) -> DataFrame:
    points = clean.to_num("score")
    return t.filter(points.between(0, 100)).groupBy("measure_id").agg(
        F.count("*").alias("rows"), F.min(points).alias("lowest"), F.max(points).alias("highest")
    )


def _in(h: DataFrame) -> DataFrame:
    return h.filter(F.col("overall_rating").isin("1", "2", "3")).select("facility_id", "overall_rating")


def _compare(h: DataFrame) -> DataFrame:
    mort, safety = clean.worse("mort"), clean.worse("safety")
    keep = ((mort > 0) | (safety >= 2)) & (F.col("state") != "NATION_3") & mort.isNotNull() & (safety <= 3)
    return h.filter(keep & ~(clean.worse("readm") < 1)).select("facility_id", "state")


def _round(x: DataFrame) -> DataFrame:
    value = F.col("timely_care_avg") / 8
    return x.select(
        "facility_id", "period", rounding.half_up(value, 2).alias("up_2"),
        rounding.half_even(value, 3).alias("even_3"), rounding.half_even(value, 4).alias("even_4"),
    )


def _arithmetic(x: DataFrame) -> DataFrame:
    star, timely, rating = F.col("patient_star_avg"), F.col("timely_care_avg"), F.col("overall_rating")
    return x.select(
        "facility_id", "period",
        rounding.half_up(star * 20 + timely - rating * 10, 6).alias("combined"),
        rounding.half_up(100.0 * rating / 5, 6).alias("rating_pct"),
    )


def _regex_date(x: DataFrame) -> DataFrame:
    dated = F.concat(F.lit("archives/hospitals_"), "period", F.lit("_release.zip"))
    plain = F.concat(F.lit("archives/"), F.substring("period", 1, 4), F.lit("Q4.zip"))
    return x.select("facility_id", "period", periods.period_of(dated).alias("dated"), periods.period_of(plain).alias("plain"))


SCALARS = {
    "fn_try_cast": on("facility")(_try_cast),
    "fn_cast": on("facility")(_guarded_cast),
    "fn_to_num": on("timely")(_to_num),
    "fn_pick": on("facility")(_pick),
    "fn_isnull": on("facility")(_isnull),
    "fn_fillna_sum": on("snapshot")(_row_sum),
    "fn_trim": on("facility")(_trim),
    "fn_yes_flag": on("facility")(lambda h: h.select("facility_id", clean.yes_flag("emergency_services").alias("flag"))),
    "fn_underperformer": on("snapshot")(_flags),
    "fn_composite": on("facility")(
        lambda h: h.select("facility_id", clean.composite_risk().cast("long").alias("composite_risk_score"))
    ),
    "fn_case": on("facility")(_case),
    "fn_between": on("timely")(_between),
    "fn_in": on("facility")(_in),
    "fn_cmp": on("facility")(_compare),
    "fn_round": on("snapshot")(_round),
    "fn_arith": on("snapshot")(_arithmetic),
    "fn_regex_date": on("snapshot")(_regex_date),
    "fn_period_index": on("snapshot")(
        lambda x: periods.period_index(x).select("facility_id", "period", F.col("t").cast("long").alias("t"))
    ),
}

# --- features, panel, trends -----------------------------------------------------


def feature_table(h: DataFrame, t: DataFrame, s: DataFrame) -> DataFrame:
    return features.assemble(features.load_general(h), features.load_hcahps(s), features.load_timely(t))


def _doubled_general(h: DataFrame) -> DataFrame:
    """Every third hospital comes twice; the later row has another name and must lose."""
    again = h.filter(F.col("row_seq") % 3 == 0).withColumns(
        {"row_seq": F.col("row_seq") + 1_000_000_000_000, "facility_name": F.lit("later duplicate")}
    )
    return features.load_general(h.unionByName(again))


def _stack(x: DataFrame) -> DataFrame:
    """Older releases lack the worse counts altogether, so the stack has to fill them."""
    early = x.filter(F.col("period") <= "1995-12-31").drop(*features.WORSE)
    return snapshots.stack([early, x.filter(F.col("period") > "1995-12-31")])


def _deltas(x: DataFrame) -> DataFrame:
    moved = panel.add_deltas(release_panel(x))
    return moved.select("facility_id", "period", *[rounding.half_even(f"{m}_delta", 6).alias(f"{m}_delta") for m in panel.METRICS])


def _last_release(x: DataFrame) -> tuple[trend_state.TrendState, DataFrame, str]:
    """Stored state of all releases but the newest, and the newest without its label."""
    past = materialize(release_panel(x), "panel")
    newest = past.agg(F.max("period")).first()[0]
    path = scratch_path(x.sparkSession, "trend-state")
    trend_state.write(trend_state.from_panel(past.filter(F.col("period") < newest)), path)
    return trend_state.read(x.sparkSession, path), past.filter(F.col("period") == newest).drop("period"), newest


def _state_warning(x: DataFrame) -> DataFrame:
    return trend_state.early_warning(trend_state.add_release(*_last_release(x)))


def _state_national(x: DataFrame) -> DataFrame:
    return trend_state.national_trends(trend_state.add_release(*_last_release(x)))


def _state_deltas(x: DataFrame) -> DataFrame:
    state, release, newest = _last_release(x)
    moved = trend_state.release_deltas(state, release).withColumn("period", F.lit(newest))
    return moved.select("facility_id", "period", *[rounding.half_even(f"{m}_delta", 6).alias(f"{m}_delta") for m in panel.METRICS])


PLANS = {
    "x_train": on("facility", "timely", "survey")(training_extract.training_extract),
    "timely_mean_all": on("timely")(timely_mean_all),
    "timely_mean_0_100": on("timely")(timely_mean_0_100),
    "f_general": on("facility")(_doubled_general),
    "f_hcahps": on("survey")(features.load_hcahps),
    "f_timely": on("timely")(features.load_timely),
    "f_assemble": on("facility", "timely", "survey")(feature_table),
    "f_targets": on("snapshot")(
        lambda x: release_panel(x).select("facility_id", "period", "composite_risk_score", "is_underperformer")
    ),
    "p_stack": on("snapshot")(_stack),
    "p_delta": on("snapshot")(_deltas),
    "t_slope": on("snapshot")(lambda x: trends.slopes(release_panel(x))),
    "t_latest": on("snapshot")(lambda x: trends.latest_attrs(release_panel(x))),
    "t_warn": on("snapshot")(lambda x: trends.early_warning(release_panel(x))),
    "t_state_warn": on("snapshot")(_state_warning),
    "t_state_national": on("snapshot")(_state_national),
    "p_state_delta": on("snapshot")(_state_deltas),
    "t_national": on("snapshot")(lambda x: trends.national_trends(release_panel(x))),
    "t_indexed": on("snapshot")(lambda x: trends.indexed_trends(trends.national_trends(release_panel(x)))),
}

# --- evaluation and triage -------------------------------------------------------


def scored_hospitals(h: DataFrame, ev: DataFrame) -> DataFrame:
    """A scored list without a model: the derived score stands in for the predicted risk."""
    rows = h.join(ev.select("facility_id", "score"), "facility_id").select(
        "facility_id", "facility_name", "state", "hospital_type", "hospital_ownership",
        clean.to_num("overall_rating").alias("overall_rating"),
        (F.col("score") * 4 + 1).alias("patient_star_avg"),
        rounding.half_even("score", 3).alias("predicted_risk"),
    )
    return triage.risk_rank(rows)


def _document(ev: DataFrame) -> DataFrame:
    report = metrics.classification_report(ev)
    total = ev.count()
    sizes = {"regression": (total, total), "classification": (total, total)}
    return documents.metrics_document(
        metrics.regression_metrics(ev, "label", "score"), metrics.roc_auc(ev), report, sizes
    )


def _profile(h: DataFrame, t: DataFrame, s: DataFrame, ev: DataFrame) -> DataFrame:
    return triage.profile(scored_hospitals(h, ev), feature_table(h, t, s), "Customer#000000007")


EVALUATION = {
    "m_rank": on("facility", "scored_eval")(scored_hospitals),
    "e_r2": on("scored_eval")(lambda x: metrics.regression_metrics(x, "label", "score").select("n", "r2")),
    "e_mae": on("scored_eval")(lambda x: metrics.regression_metrics(x, "label", "score").select("n", "mae")),
    "e_auc": on("scored_eval")(metrics.roc_auc),
    "e_report": on("scored_eval")(metrics.classification_report),
    "d_states": on("facility", "scored_eval")(lambda h, ev: triage.state_list(scored_hospitals(h, ev))),
    "d_triage": on("facility", "scored_eval")(lambda h, ev: triage.triage(scored_hospitals(h, ev), "NATION_3", 15)),
    "d_profile": on("facility", "timely", "survey", "scored_eval")(_profile),
    "d_card": on("scored_eval")(lambda x: triage.model_card(_document(x))),
}


def jobs() -> dict[str, Query]:
    return {**PROFILING, **SCALARS, **PLANS, **EVALUATION}


__all__ = ["jobs", "on", "feature_table", "scored_hospitals", "release_panel"]

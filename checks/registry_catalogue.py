"""Registered catalogue queries q01-q75 over the derived provider tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.provider_tables import provider
from wardlens.operators import experience as e
from wardlens.operators import geography as g
from wardlens.operators import grouping as k
from wardlens.operators import ownership as o
from wardlens.operators import safety as c
from wardlens.operators import timeliness as t
from wardlens.operators.ranking import sort_rows

Query = Callable[[SparkSession, str], DataFrame]

STATE, COUNTY, NAME = "NATION_3", "nation_3 county 1", "Customer#000000001"


def _on(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    def bind(fn: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: fn(*[provider(spark, sf_dir, n) for n in names])

    return bind


def _view(name: str, order: list[str], *tables: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """Register the result as a temp view and read it back."""

    def bind(fn: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            fn(*[provider(spark, sf_dir, n) for n in tables]).createOrReplaceTempView(name)
            view = spark.table(name)
            return sort_rows(view, *[F.desc(c) for c in order]) if order else view

        return run

    return bind


def catalogue() -> dict[str, Query]:
    h, ts, s = _on("facility"), _on("timely"), _on("survey")
    th, sh, hs = _on("timely", "facility"), _on("survey", "facility"), _on("facility", "survey")
    return {
        "q01": h(lambda f: g.hospitals_in_state(f, STATE)),
        "q02": h(g.distinct_states),
        "q03": h(g.with_rating),
        "q04": h(lambda f: g.hospitals_in_county(f, COUNTY)),
        "q05": h(lambda f: g.top_rated(f, STATE, 20)),
        "q06": h(g.hospitals_per_state),
        "q07": h(g.avg_rating_per_state),
        "q08": h(g.low_rated_counties),
        "q09": h(g.emergency_split),
        "q10": h(lambda f: g.count_worse_by(f, "mort", "state")),
        "q11": h(g.rank_states),
        "q12": h(lambda f: g.bottom_n_per(f, "state", 1)),
        "q13": h(g.counties_below_national),
        "q14": _view("state_summary", ["average_rating"], "facility")(g.v_state_summary),
        "q15": h(lambda f: g.bottom_n_per(f, "state", 3)),
        "q16": h(o.type_ownership_list),
        "q17": h(lambda f: k.distinct_values(f, "hospital_ownership")),
        "q18": h(o.by_ownership),
        "q19": h(o.by_type),
        "q20": h(o.no_emergency),
        "q21": h(lambda f: k.count_by(f, "hospital_ownership")),
        "q22": h(lambda f: k.avg_rating_by(f, "hospital_type")),
        "q23": h(lambda f: o.avg_rating_having(f, "hospital_ownership", 2.9)),
        "q24": h(o.birthing_by_ownership),
        "q25": h(o.profit_class_mortality),
        "q26": h(lambda f: k.rank_groups(f, "hospital_ownership", "ownership_rank")),
        "q27": h(o.pct_zero_safety),
        "q28": _view("type_ownership", ["average_rating"], "facility")(o.v_type_ownership),
        "q29": h(o.best_group_per),
        "q30": h(lambda f: k.below_national(f, ["hospital_ownership"], "average_rating", show=True)),
        "q31": h(c.worse_counts),
        "q32": h(lambda f: c.worse_gt(f, "readm", 0)),
        "q33": h(lambda f: c.worse_eq(f, "mort", 0)),
        "q34": h(lambda f: c.better_gt(f, "safety", 2)),
        "q35": h(c.all_zero),
        "q36": h(lambda f: c.avg_worse_by(f, "mort", "state", "avg_mortality_measures")),
        "q37": h(lambda f: g.count_worse_by(f, "readm", "hospital_type", "total_hospitals")),
        "q38": h(c.avg_worse_by_rating),
        "q39": h(lambda f: g.count_worse_by(f, "mort", "state", "total_hospitals", more_than=10)),
        "q40": h(lambda f: c.avg_worse_by(f, "readm", "emergency_services", "avg_readmission_measures")),
        "q41": h(c.rank_by_composite),
        "q42": h(c.high_risk_by_state),
        "q43": _view("risk_summary", ["composite_risk_score"], "facility")(c.v_risk_summary),
        "q44": h(c.worst_per_state),
        "q45": h(c.above_national),
        "q46": ts(lambda x: t.measures_for(x, NAME)),
        "q47": ts(t.condition_records),
        "q48": ts(lambda x: k.distinct_values(x, "condition_name")),
        "q49": ts(t.perfect_scores),
        "q50": ts(t.missing_scores),
        "q51": ts(lambda x: t.avg_score_by(x, "measure_name")),
        "q52": ts(lambda x: t.avg_score_by(x, "condition_name", lowest_first=True)),
        "q53": ts(t.reporters_per_measure),
        "q54": th(t.avg_score_by_state),
        "q55": th(t.states_below_national),
        "q56": th(t.rank_in_state),
        "q57": _view("timely_summary", [], "timely", "facility")(t.v_timely_summary),
        "q58": ts(t.flag_bottom),
        "q59": ts(t.score_change),
        "q60": th(t.timely_by_rating),
        "q61": s(lambda x: e.answers_for(x, NAME)),
        "q62": s(e.five_star),
        "q63": s(lambda x: k.distinct_values(x, "hcahps_question")),
        "q64": s(e.low_response),
        "q65": s(e.top_completed),
        "q66": sh(lambda x, f: e.avg_star_by(x, f, "state")),
        "q67": s(e.avg_answer_by_measure),
        "q68": sh(e.low_response_by_ownership),
        "q69": sh(lambda x, f: e.avg_star_by(x, f, "emergency_services")),
        "q70": sh(e.states_many_low),
        "q71": hs(e.risk_vs_satisfaction),
        "q72": sh(e.top_star_per_state),
        "q73": _view("patient_experience", ["avg_star_rating"], "survey", "facility")(e.v_patient_experience),
        "q74": s(e.response_change),
        "q75": _on("facility", "timely", "survey")(e.scorecard),
    }

"""DuckDB statements for the registered jobs."""

from __future__ import annotations

from checks.oracle_catalogue import even, over, up
from checks.provider_tables import ctes

# Column names of the feature table.
METRICS = ("patient_star_avg", "survey_response_rate", "timely_care_avg", "overall_rating", "composite_risk_score")
LENGTH_COLUMNS = (
    "facility_id", "facility_name", "city_town", "state", "county_parish", "hospital_type", "hospital_ownership",
    "emergency_services", "birthing_friendly", "overall_rating",
    "count_mort_measures_worse", "count_safety_measures_worse", "count_readm_measures_worse",
    "count_safety_measures_better", "count_mort_measures_better", "count_mort_measures_no_different",
    "count_safety_measures_no_different", "count_readm_measures_better", "count_readm_measures_no_different",
)
PANEL_COLUMNS = (
    "facility_id", "period", "facility_name", "state", "patient_star_avg", "survey_response_rate", "timely_care_avg",
    "overall_rating", "_mort_worse", "_safety_worse", "_readm_worse", "composite_risk_score", "is_underperformer",
)

_WORSE_SUM = "coalesce(_mort_worse,0) + coalesce(_safety_worse,0) + coalesce(_readm_worse,0)"
_PANEL = f"""w AS (SELECT *, {_WORSE_SUM} AS total,
  bool_or(coalesce(_mort_worse, _safety_worse, _readm_worse) IS NOT NULL) OVER (PARTITION BY period) AS known FROM snapshot),
 panel AS (SELECT * EXCLUDE (total, known), CASE WHEN known THEN total END AS composite_risk_score,
  CASE WHEN coalesce(overall_rating <= 2, false) OR total > 0 THEN 1 ELSE 0 END AS is_underperformer FROM w),
 timed AS (SELECT panel.*, dense_rank() OVER (ORDER BY period) - 1 AS t FROM panel)"""


def on_snapshot(body: str) -> str:
    return f"WITH {ctes('snapshot')} {body}"


def on_panel(body: str) -> str:
    lead = "," if body.lstrip().startswith("@") else ""
    return f"WITH {ctes('snapshot')},\n{_PANEL}{lead} {body.lstrip().lstrip('@')}"


def on_eval(body: str) -> str:
    return f"WITH {ctes('scored_eval')} {body}"


def _stacked(rows: list[str]) -> str:
    return " UNION ALL ".join(rows)


def profiling() -> dict[str, str]:
    categories = ("birthing_friendly", "emergency_services", "overall_rating", "hospital_type", "hospital_ownership")
    return {
        "prof_lengths": over(
            "h",
            _stacked(
                [
                    f"SELECT CAST({i + 1} AS INTEGER) AS position, '{c}' AS column_name,"
                    f" CAST(coalesce(max(length({c})),0) AS INTEGER) AS max_length FROM h"
                    for i, c in enumerate(LENGTH_COLUMNS)
                ]
            ),
        ),
        "prof_rowcounts": over(
            "hts",
            _stacked(
                [
                    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {k}"
                    for n, k in (("hospital_general_info", "h"), ("timely_effective_care", "t"), ("hcahps_survey", "s"))
                ]
            ),
        ),
        "prof_distinct": over(
            "h", " UNION ".join(f"SELECT '{c}' AS column_name, {c} AS value FROM h" for c in categories)
        ),
        "prof_coverage": on_panel(
            _stacked(
                [
                    f"SELECT '{c}' AS column_name, {even(f'100.0 * count({c}) / count(*)', 1)} AS coverage_pct FROM panel"
                    for c in PANEL_COLUMNS
                ]
            )
        ),
        "prof_balance": on_panel(
            f"SELECT is_underperformer, {even('count(*) / (SELECT count(*) FROM panel)', 3)} AS share FROM panel GROUP BY ALL"
        ),
        "prof_panel": on_panel(
            """SELECT count(*) AS row_count, count(DISTINCT facility_id) AS hospitals, count(DISTINCT period) AS periods,
 CAST(max(CASE WHEN period LIKE 'SIM-%' THEN 1 ELSE 0 END) AS INTEGER) AS has_simulated FROM panel"""
        ),
    }


def scalars() -> dict[str, str]:
    return {
        "fn_try_cast": over(
            "h",
            "SELECT facility_id, CAST(stars AS INTEGER) AS as_int, CAST(mort AS DOUBLE) AS as_double, stars AS as_rating FROM h",
        ),
        "fn_cast": over("h", "SELECT facility_id, CAST(overall_rating AS INTEGER) AS stars FROM h WHERE stars IS NOT NULL"),
        "fn_to_num": over("t", "SELECT facility_id, measure_id, score, points FROM t"),
        "fn_pick": over(
            "h",
            "SELECT facility_id, county_parish AS county, CAST(mort AS DOUBLE) AS worse, CAST(NULL AS VARCHAR) AS absent FROM h",
        ),
        "fn_isnull": over("h", "SELECT facility_id, CAST(coalesce(readm, 0) AS INTEGER) AS readm_worse FROM h"),
        "fn_fillna_sum": on_snapshot(f"SELECT facility_id, period, {_WORSE_SUM} AS worse_total FROM snapshot"),
        "fn_trim": over("h", "SELECT facility_id, facility_name FROM h"),
        "fn_yes_flag": over(
            "h", "SELECT facility_id, CAST(CASE WHEN emergency_services = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS flag FROM h"
        ),
        "fn_underperformer": on_panel("SELECT facility_id, period, is_underperformer FROM panel"),
        "fn_composite": over("h", "SELECT facility_id, risk AS composite_risk_score FROM h"),
        "fn_case": over(
            "h",
            """SELECT CASE WHEN mort >= 2 THEN 'several' WHEN mort = 1 THEN 'one' WHEN mort = 0 THEN 'none' ELSE 'unknown' END
 AS mortality, count(*) AS hospitals FROM h GROUP BY 1""",
        ),
        "fn_between": over(
            "t",
            """SELECT measure_id, count(*) AS rows, min(points) AS lowest, max(points) AS highest FROM t
 WHERE points BETWEEN 0 AND 100 GROUP BY measure_id""",
        ),
        "fn_in": over("h", "SELECT facility_id, overall_rating FROM h WHERE stars IN (1, 2, 3)"),
        "fn_cmp": over(
            "h",
            """SELECT facility_id, state FROM h WHERE (mort > 0 OR safety >= 2) AND state <> 'NATION_3'
 AND mort IS NOT NULL AND safety <= 3 AND NOT (readm < 1)""",
        ),
        "fn_round": on_snapshot(
            f"""SELECT facility_id, period, {up('timely_care_avg / 8', 2)} AS up_2, {even('timely_care_avg / 8', 3)} AS even_3,
 {even('timely_care_avg / 8', 4)} AS even_4 FROM snapshot"""
        ),
        "fn_arith": on_snapshot(
            f"""SELECT facility_id, period, {up('patient_star_avg * 20 + timely_care_avg - overall_rating * 10', 6)} AS combined,
 {up('100.0 * overall_rating / 5', 6)} AS rating_pct FROM snapshot"""
        ),
        "fn_regex_date": on_snapshot(
            "SELECT facility_id, period, period AS dated, period[1:4] || 'Q4' AS plain FROM snapshot"
        ),
        "fn_period_index": on_panel("SELECT facility_id, period, t FROM timed"),
    }


def feature_ctes() -> str:
    """Oracle CTEs of the feature table over one release."""
    return f"""hc AS (SELECT facility_id, avg(star) AS patient_star_avg, CAST(max(rate) AS DOUBLE) AS survey_response_rate,
  CAST(max(done) AS DOUBLE) AS completed_surveys FROM s GROUP BY ALL),
 ti AS (SELECT facility_id, avg(points) AS timely_care_avg FROM t WHERE points BETWEEN 0 AND 100 GROUP BY ALL),
 gen AS (SELECT facility_id, facility_name, state, county_parish AS county, hospital_type, hospital_ownership,
  CAST(CASE WHEN emergency_services = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS emergency_services,
  stars AS overall_rating, CAST(mort AS DOUBLE) AS _mort_worse, CAST(safety AS DOUBLE) AS _safety_worse,
  CAST(readm AS DOUBLE) AS _readm_worse, CAST(risk AS DOUBLE) AS risk FROM h),
 feat AS (SELECT gen.* EXCLUDE (risk), patient_star_avg, survey_response_rate, completed_surveys, timely_care_avg,
  CASE WHEN (SELECT bool_or(coalesce(mort, safety, readm) IS NOT NULL) FROM h) THEN risk END AS composite_risk_score,
  CAST(CASE WHEN coalesce(overall_rating <= 2, false) OR risk > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_underperformer
  FROM gen LEFT JOIN hc USING (facility_id) LEFT JOIN ti USING (facility_id))"""


def plans() -> dict[str, str]:
    counts = ", ".join(
        f"TRY_CAST(count_{g}_measures_{k} AS INTEGER) AS count_{g}_measures_{k}"
        for g in ("mort", "safety", "readm")
        for k in ("better", "no_different", "worse")
    )
    slope = "CASE WHEN count({0}) >= 2 THEN regr_slope({0}, t) END"
    sat, risk = slope.format("patient_star_avg"), slope.format("composite_risk_score")
    latest = """last_row AS (SELECT facility_id, facility_name, state FROM panel
 QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY period DESC) = 1)"""
    fitted = f"fitted AS (SELECT facility_id, {sat} AS sat, {risk} AS risk FROM timed GROUP BY facility_id)"
    national = "nat AS (SELECT period, " + ", ".join(f"{even(f'avg({m})', 3)} AS {m}" for m in METRICS) + " FROM panel GROUP BY period)"
    indexed = ", ".join(
        f"{even(f'nat.{m} / nullif(f.{m}, 0) * 100', 6)} AS {m}" for m in ("patient_star_avg", "timely_care_avg", "overall_rating")
    )
    deltas = ", ".join(
        f"{even(f'{m} - lag({m}) OVER (PARTITION BY facility_id ORDER BY period)', 6)} AS {m}_delta" for m in METRICS
    )
    general = (
        "facility_id, facility_name, state, county, hospital_type, hospital_ownership, emergency_services, overall_rating,"
        " _mort_worse, _safety_worse, _readm_worse"
    )
    return {
        "x_train": over(
            "hts",
            f"""@ta AS (SELECT facility_id, avg(points) AS avg_timely_score FROM t WHERE points IS NOT NULL GROUP BY ALL),
 sa AS (SELECT facility_id, avg(star) AS avg_patient_star_rating, avg(rate) AS avg_response_rate,
  CAST(sum(done) AS BIGINT) AS total_completed_surveys FROM s GROUP BY ALL)
SELECT facility_id, facility_name, state, hospital_type, hospital_ownership, emergency_services, birthing_friendly, {counts},
 avg_timely_score, avg_patient_star_rating, avg_response_rate, total_completed_surveys, CAST(stars AS INTEGER) AS overall_rating
 FROM h LEFT JOIN ta USING (facility_id) LEFT JOIN sa USING (facility_id) WHERE stars IS NOT NULL""",
        ),
        "timely_mean_all": over(
            "t", "SELECT facility_id, avg(points) AS avg_timely_score FROM t WHERE points IS NOT NULL GROUP BY facility_id"
        ),
        "timely_mean_0_100": over(
            "t",
            "SELECT facility_id, avg(points) AS timely_care_avg FROM t WHERE points BETWEEN 0 AND 100 GROUP BY facility_id",
        ),
        "f_general": over("hts", f"@{feature_ctes()} SELECT {general} FROM gen"),
        "f_hcahps": over("hts", f"@{feature_ctes()} SELECT * FROM hc"),
        "f_timely": over("hts", f"@{feature_ctes()} SELECT * FROM ti"),
        "f_assemble": over("hts", f"@{feature_ctes()} SELECT * FROM feat"),
        "f_targets": on_panel("SELECT facility_id, period, composite_risk_score, is_underperformer FROM panel"),
        "p_stack": on_snapshot("SELECT * FROM snapshot"),
        "p_delta": on_panel(f"SELECT facility_id, period, {deltas} FROM panel"),
        "t_slope": on_panel(
            f"@{fitted} SELECT facility_id, {even('sat', 4)} AS satisfaction_slope, {even('risk', 4)} AS risk_slope FROM fitted"
        ),
        "t_latest": on_panel(f"@{latest} SELECT * FROM last_row"),
        "t_warn": on_panel(
            f"""@{fitted}, {latest} SELECT facility_id, facility_name, state, {even('sat', 4)} AS satisfaction_slope,
 {even('risk', 4)} AS risk_slope, CAST(coalesce({even('sat', 9)} < -0.03, false) OR coalesce({even('risk', 9)} > 0.05, false) AS INTEGER)
 AS declining_trajectory FROM fitted JOIN last_row USING (facility_id)"""
        ),
        "t_state_warn": on_panel(
            f"""@{fitted}, {latest} SELECT facility_id, facility_name, state, {even('sat', 4)} AS satisfaction_slope,
 {even('risk', 4)} AS risk_slope, CAST(coalesce({even('sat', 9)} < -0.03, false) OR coalesce({even('risk', 9)} > 0.05, false) AS INTEGER)
 AS declining_trajectory FROM fitted JOIN last_row USING (facility_id)"""
        ),
        "t_national": on_panel(f"@{national} SELECT * FROM nat"),
        "t_state_national": on_panel(f"@{national} SELECT * FROM nat"),
        "p_state_delta": on_panel(
            f"@moved AS (SELECT facility_id, period, {deltas} FROM panel) SELECT * FROM moved WHERE period = (SELECT max(period) FROM panel)"
        ),
        "t_indexed": on_panel(
            f"@{national} SELECT nat.period, {indexed} FROM nat, (SELECT * FROM nat ORDER BY period LIMIT 1) f"
        ),
    }


_SCORED = f"""scored AS (SELECT facility_id, facility_name, state, hospital_type, hospital_ownership, stars AS overall_rating,
  score * 4 + 1 AS patient_star_avg, {even('score', 3)} AS predicted_risk,
  rank() OVER (ORDER BY {even('score', 3)} DESC) AS risk_rank FROM h JOIN scored_eval USING (facility_id))"""

_REPORT = f"""c AS (SELECT k, count(*) FILTER (label = k) AS support, count(*) FILTER (said = k) AS said_n,
  count(*) FILTER (label = k AND said = k) AS hits
  FROM (SELECT label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS said FROM scored_eval), (VALUES (0), (1)) v(k) GROUP BY k),
 r AS (SELECT *, coalesce(hits / nullif(said_n, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS q FROM c),
 f AS (SELECT *, coalesce(2 * p * q / nullif(p + q, 0), 0) AS f1 FROM r)"""

_FIT = "count(*) AS n, {r2} AS r2, {mae} AS mae".format(
    r2=even("1 - sum((label - score) * (label - score)) / (var_pop(label) * count(*))", 3),
    mae=even("avg(abs(label - score))", 3),
)
_AUC = f"""g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored_eval GROUP BY score),
 b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
 auc AS (SELECT {even('sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))', 6)} AS roc_auc,
  CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives FROM b)"""


def evaluation() -> dict[str, str]:
    def scored(body: str) -> str:
        return f"WITH {ctes('scored_eval')}, {over('hts', '@' + feature_ctes() + ', ' + _SCORED + body)[len('WITH '):]}"

    weighted = "sum({0} * support) / sum(support)"
    return {
        "m_rank": scored(" SELECT * FROM scored"),
        "e_r2": on_eval(f"SELECT n, r2 FROM (SELECT {_FIT} FROM scored_eval)"),
        "e_mae": on_eval(f"SELECT n, mae FROM (SELECT {_FIT} FROM scored_eval)"),
        "e_auc": on_eval(f", {_AUC} SELECT * FROM auc"),
        "e_report": on_eval(
            f""", {_REPORT}
SELECT CAST(k AS VARCHAR) AS class, {even('p', 6)} AS precision, {even('q', 6)} AS recall, {even('f1', 6)} AS f1_score, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, {even('sum(hits) / sum(support)', 6)}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', {even('avg(p)', 6)}, {even('avg(q)', 6)}, {even('avg(f1)', 6)}, CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', {even(weighted.format('p'), 6)}, {even(weighted.format('q'), 6)}, {even(weighted.format('f1'), 6)},
 CAST(sum(support) AS BIGINT) FROM f"""
        ),
        "d_states": scored(" SELECT DISTINCT state FROM scored"),
        "d_triage": scored(
            """ SELECT risk_rank, facility_name, state, hospital_type, predicted_risk AS "risk_score (0-1)", overall_rating,
 patient_star_avg AS patient_stars FROM scored WHERE state = 'NATION_3' ORDER BY predicted_risk DESC, facility_id LIMIT 15"""
        ),
        "d_profile": scored(
            f""" SELECT scored.facility_name, {even('predicted_risk * 100', 0)} AS predicted_risk_pct,
 {even('scored.overall_rating', 0)} AS overall_rating, {even('scored.patient_star_avg', 1)} AS patient_star_avg, risk_rank,
 feat.state, feat.hospital_type AS type, feat.hospital_ownership AS ownership, feat.emergency_services = 1 AS emergency_services,
 survey_response_rate AS survey_response_rate_pct, {even('timely_care_avg', 1)} AS timely_care_avg
 FROM scored JOIN feat USING (facility_id) WHERE scored.facility_name = 'Customer#000000007'
 ORDER BY predicted_risk DESC, facility_id LIMIT 1"""
        ),
        "d_card": on_eval(
            f""", {_AUC}, {_REPORT}, fit AS (SELECT {_FIT} FROM scored_eval)
SELECT 'regression' AS task, 'patient_star_avg' AS target, n AS n_train, n AS n_test, r2 AS score, mae AS detail FROM fit
UNION ALL SELECT 'classification', 'is_underperformer', (SELECT n FROM fit), (SELECT n FROM fit), (SELECT roc_auc FROM auc),
 {even('q', 2)} FROM f WHERE k = 1"""
        ),
    }


def jobs() -> dict[str, str]:
    return {**profiling(), **scalars(), **plans(), **evaluation()}

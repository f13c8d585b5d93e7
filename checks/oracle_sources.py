"""DuckDB statements for the readers and writers: what went in has to come out."""

from __future__ import annotations

from checks.oracle_catalogue import over
from checks.oracle_jobs import feature_ctes, jobs, on_panel
from checks.provider_tables import ctes
from wardlens.sources.schemas import GENERAL_COLUMNS, GENERAL_FIELDS

KNOWN = (
    "facility_id", "facility_name", "city_town", "state", "county_parish", "hospital_type", "hospital_ownership",
    "emergency_services", "birthing_friendly", "overall_rating",
) + tuple(f"count_{g}_measures_{k}" for g in ("mort", "safety", "readm") for k in ("better", "no_different", "worse"))
ROWS_PER_RELEASE = 20_000


def _dealt(name: str, key: str) -> str:
    """CTE of a derived table with the release its rows were dealt to."""
    body = ctes(name).removeprefix(f"{name} AS (").removesuffix(")")
    return f"{name} AS ({body.replace(' SELECT ', f' SELECT {key} % (SELECT n FROM shards) AS shard, ', 1)})"


def _archive() -> str:
    return f"""WITH shards AS (SELECT CAST(ceil(count(*) / {ROWS_PER_RELEASE}.0) AS BIGINT) AS n FROM lineitem),
{ctes('facility')},
{_dealt('survey', 'o_orderkey')},
{_dealt('timely', 'l_orderkey')},
gen AS (SELECT row_seq % (SELECT n FROM shards) AS shard, facility_id, facility_name || ' é' AS facility_name, state,
  county_parish AS county, hospital_type, hospital_ownership,
  CAST(CASE WHEN emergency_services = 'Yes' THEN 1 ELSE 0 END AS INTEGER) AS emergency_services,
  TRY_CAST(overall_rating AS DOUBLE) AS overall_rating, TRY_CAST(count_mort_measures_worse AS DOUBLE) AS _mort_worse,
  TRY_CAST(count_safety_measures_worse AS DOUBLE) AS _safety_worse, TRY_CAST(count_readm_measures_worse AS DOUBLE) AS _readm_worse
  FROM facility),
hc AS (SELECT shard, facility_id, avg(TRY_CAST(patient_survey_star_rating AS DOUBLE)) AS patient_star_avg,
  max(TRY_CAST(survey_response_rate_percent AS DOUBLE)) AS survey_response_rate,
  max(TRY_CAST(number_of_completed_surveys AS DOUBLE)) AS completed_surveys FROM survey GROUP BY ALL),
ti AS (SELECT shard, facility_id, avg(TRY_CAST(score AS DOUBLE)) AS timely_care_avg FROM timely
  WHERE TRY_CAST(score AS DOUBLE) BETWEEN 0 AND 100 GROUP BY ALL),
j AS (SELECT * FROM gen LEFT JOIN hc USING (shard, facility_id) LEFT JOIN ti USING (shard, facility_id)),
w AS (SELECT *, coalesce(_mort_worse,0) + coalesce(_safety_worse,0) + coalesce(_readm_worse,0) AS total,
  bool_or(coalesce(_mort_worse, _safety_worse, _readm_worse) IS NOT NULL) OVER (PARTITION BY shard) AS known FROM j)
SELECT 'r' || shard AS period, * EXCLUDE (shard, total, known), CASE WHEN known THEN total END AS composite_risk_score,
  CAST(CASE WHEN coalesce(overall_rating <= 2, false) OR total > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_underperformer FROM w"""


def _snapshots() -> str:
    """Past releases as ready tables, without what the derived snapshots do not have, and the current one assembled."""
    past = on_panel("SELECT * FROM panel")
    current = over("hts", f"@{feature_ctes()} SELECT * FROM feat")
    return f"""WITH past AS ({past}), current AS ({current})
SELECT * FROM past UNION ALL BY NAME SELECT *, 'current' AS period FROM current"""


def sources() -> dict[str, str]:
    job = jobs()
    return {
        "src_csv_positional": over(
            "h", "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" if c in KNOWN else f"'' AS {c}" for c in GENERAL_COLUMNS) + " FROM h"
        ),
        "src_csv_text": over(
            "h",
            "SELECT " + ", ".join(
                f"{c} || ' é' AS {c}" if c == "facility_name" else f"nullif({c}, '') AS {c}" for c in GENERAL_FIELDS
            ) + " FROM h",
        ),
        "src_clean": over("t", "SELECT facility_id, period, score, points, lower(measure_id) AS measure FROM t"),
        "src_archive": _archive(),
        "src_snapshots": _snapshots(),
        "src_derived_csv": job["t_warn"],
        "sink_features": over("hts", f"@{feature_ctes()} SELECT * FROM feat"),
        "sink_panel": on_panel(
            """SELECT facility_id, period, overall_rating,
 overall_rating - lag(overall_rating) OVER (PARTITION BY facility_id ORDER BY period) AS overall_rating_delta,
 composite_risk_score FROM panel"""
        ),
        "sink_releases": on_panel(
            """SELECT facility_id, period, overall_rating,
 overall_rating - lag(overall_rating) OVER (PARTITION BY facility_id ORDER BY period) AS overall_rating_delta,
 composite_risk_score FROM panel"""
        ),
        "sink_trends": job["t_warn"],
        "sink_scored": job["m_rank"],
    }

"""Provider tables derived from the driver's test tables.

The SQL below runs unchanged on Spark and on DuckDB: customer is a hospital,
nation a state, lineitem a care measure, orders a survey row, the year of an
order a release. Missing words in both letter cases, empty and NULL scores,
mixed-case counties, scores above 100 and releases without worse counts occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_COUNTS = """
  CASE WHEN c_custkey % 6 = 0 THEN 'Not Available' ELSE CAST((c_custkey % 17) % 3 AS STRING) END AS count_mort_measures_worse,
  CASE WHEN c_custkey % 7 = 0 THEN 'Not Available' ELSE CAST((c_custkey % 19) % 4 AS STRING) END AS count_safety_measures_worse,
  CASE WHEN c_custkey % 8 = 0 THEN 'Not Available' ELSE CAST((c_custkey % 23) % 3 AS STRING) END AS count_readm_measures_worse,
  CASE WHEN c_custkey % 7 = 0 THEN 'Not Available' ELSE CAST((c_custkey % 29) % 5 AS STRING) END AS count_safety_measures_better,
  CASE WHEN c_custkey % 6 = 0 THEN 'Not Available' ELSE CAST((c_custkey % 31) % 4 AS STRING) END AS count_mort_measures_better,
  CASE WHEN c_custkey % 6 = 0 THEN 'Not Applicable' ELSE CAST((c_custkey % 13) % 5 AS STRING) END AS count_mort_measures_no_different,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST((c_custkey % 11) % 6 AS STRING) END AS count_safety_measures_no_different,
  CASE WHEN c_custkey % 8 = 0 THEN 'N/A' ELSE CAST((c_custkey % 27) % 4 AS STRING) END AS count_readm_measures_better,
  CASE WHEN c_custkey % 8 = 0 THEN '*' ELSE CAST((c_custkey % 21) % 7 AS STRING) END AS count_readm_measures_no_different
"""

SOURCES = {
    "facility": ("customer", "nation"),
    "timely": ("lineitem", "orders", "customer", "nation"),
    "survey": ("orders", "customer", "nation"),
    "snapshot": ("orders", "customer", "nation"),
    "scored_eval": ("customer",),
}

PROVIDER_SQL = {
    "facility": """
 SELECT c_custkey AS row_seq, lpad(CAST(c_custkey AS STRING),6,'0') AS facility_id,
  c_name AS facility_name,
  'City ' || CAST(c_custkey % 50 AS STRING) AS city_town,
  n_name AS state,
  CASE WHEN c_custkey % 8 >= 4 THEN upper(n_name || ' County ' || CAST(c_custkey % 4 AS STRING))
       ELSE n_name || ' County ' || CAST(c_custkey % 4 AS STRING) END AS county_parish,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Critical Access Hospitals' WHEN 'MACHINERY' THEN 'Acute Care Hospitals' ELSE c_mktsegment END AS hospital_type,
  CASE c_custkey % 9 WHEN 0 THEN 'Proprietary' WHEN 1 THEN 'Proprietary'
   WHEN 2 THEN 'Voluntary non-profit - Private' WHEN 3 THEN 'Voluntary non-profit - Church'
   WHEN 4 THEN 'Voluntary non-profit - Other' WHEN 5 THEN 'Government - State'
   WHEN 6 THEN 'Government - Local' ELSE 'Physician' END AS hospital_ownership,
  CASE WHEN c_custkey % 4 = 1 THEN 'No' ELSE 'Yes' END AS emergency_services,
  CASE WHEN c_custkey % 3 = 0 THEN 'Y' ELSE '' END AS birthing_friendly,
  CASE WHEN c_custkey % 11 = 0 THEN 'Not Available' WHEN c_custkey % 37 = 5 THEN 'not available'
       ELSE CAST(1 + (c_custkey*7 + c_nationkey*3) % 5 AS STRING) END AS overall_rating,
"""
    + _COUNTS
    + """
 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "timely": """
 SELECT lpad(CAST(o_custkey AS STRING),6,'0') AS facility_id, c_name AS facility_name,
  n_name AS state,
  CASE l_returnflag WHEN 'A' THEN 'Emergency Department' WHEN 'N' THEN 'Healthcare Personnel Vaccination' ELSE 'Sepsis Care' END AS condition_name,
  CASE l_linenumber WHEN 1 THEN 'IMM_3' WHEN 2 THEN 'OP_23' ELSE 'M_' || CAST(l_linenumber AS STRING) END AS measure_id,
  'Measure ' || CAST(l_linenumber AS STRING) AS measure_name,
  CASE WHEN l_partkey % 9 = 0 THEN 'Not Available' WHEN l_partkey % 50 = 1 THEN '' WHEN l_partkey % 50 = 2 THEN NULL
       ELSE CAST((l_partkey*3 + l_suppkey) % 131 AS STRING) END AS score,
  lpad(CAST(quarter(l_shipdate)*3-2 AS STRING),2,'0') || '/01/' || CAST(year(l_shipdate) AS STRING) AS start_date,
  lpad(CAST(quarter(l_shipdate)*3 AS STRING),2,'0') || '/28/' || CAST(year(l_shipdate) AS STRING) AS end_date,
  CAST(year(o_orderdate) AS STRING) || '-12-31' AS period
 FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "survey": """
 SELECT lpad(CAST(o_custkey AS STRING),6,'0') AS facility_id, c_name AS facility_name, n_name AS state,
  CASE o_orderkey % 3 WHEN 0 THEN 'H_STAR_RATING' WHEN 1 THEN 'H_COMP_1' ELSE 'H_CLEAN' END AS hcahps_measure_id,
  'Question ' || CAST(o_orderkey % 7 AS STRING) AS hcahps_question,
  'Answer ' || CAST(o_orderkey % 4 AS STRING) AS hcahps_answer_description,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Not Applicable' ELSE CAST(1 + (o_orderkey + o_custkey) % 5 AS STRING) END AS patient_survey_star_rating,
  CASE WHEN o_orderkey % 10 = 3 THEN 'Not Applicable' ELSE CAST((o_orderkey*11) % 101 AS STRING) END AS hcahps_answer_percent,
  CASE WHEN o_orderkey % 14 = 0 THEN 'Not Available' ELSE CAST((o_orderkey*17) % 4000 AS STRING) END AS number_of_completed_surveys,
  CASE WHEN o_orderkey % 13 = 0 THEN 'Not Available' ELSE CAST(10 + (o_orderkey*3) % 40 AS STRING) END AS survey_response_rate_percent,
  lpad(CAST(quarter(o_orderdate)*3-2 AS STRING),2,'0') || '/01/' || CAST(year(o_orderdate) AS STRING) AS start_date,
  lpad(CAST(quarter(o_orderdate)*3 AS STRING),2,'0') || '/28/' || CAST(year(o_orderdate) AS STRING) AS end_date,
  CAST(year(o_orderdate) AS STRING) || '-12-31' AS period
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "snapshot": """
 SELECT lpad(CAST(o_custkey AS STRING),6,'0') AS facility_id, CAST(year(o_orderdate) AS STRING) || '-12-31' AS period,
  min(c_name) AS facility_name, min(n_name) AS state,
  avg(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(1 + (o_orderkey + o_custkey) % 5 AS DOUBLE) END) AS patient_star_avg,
  max(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(10 + (o_orderkey*3) % 40 AS DOUBLE) END) AS survey_response_rate,
  avg(CAST((o_orderkey*5) % 101 AS DOUBLE)) AS timely_care_avg,
  CAST(1 + (o_custkey + year(o_orderdate)) % 5 AS DOUBLE) AS overall_rating,
  CASE WHEN year(o_orderdate) <= 1995 THEN NULL WHEN o_custkey % 6 = 0 THEN NULL ELSE CAST((o_custkey + year(o_orderdate)) % 3 AS DOUBLE) END AS _mort_worse,
  CASE WHEN year(o_orderdate) <= 1995 THEN NULL ELSE CAST((o_custkey * year(o_orderdate)) % 4 AS DOUBLE) END AS _safety_worse,
  CASE WHEN year(o_orderdate) <= 1995 THEN NULL ELSE CAST((o_custkey + 2*year(o_orderdate)) % 2 AS DOUBLE) END AS _readm_worse
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
 GROUP BY o_custkey, year(o_orderdate)""",
    "scored_eval": """
 SELECT lpad(CAST(c_custkey AS STRING),6,'0') AS facility_id, CAST((c_custkey * 37) % 101 AS DOUBLE) / 100 AS score,
  CASE WHEN (c_custkey * 37) % 101 + (c_custkey % 40) > 70 THEN 1 ELSE 0 END AS label
 FROM {customer}""",
}


def provider(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a lazy frame over the whole test tables."""
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES[name]}
    return spark.sql(PROVIDER_SQL[name], **base)


def ctes(*names: str) -> str:
    """``name AS (...)`` items for an oracle's WITH clause."""
    plain = {t: t for t in ("customer", "nation", "lineitem", "orders")}
    return ",\n".join(f"{n} AS ({PROVIDER_SQL[n].format(**plain)})" for n in names)

"""DuckDB statements for q01-q75, over the derived provider tables."""

from __future__ import annotations

from checks.provider_tables import ctes

_TYPED = {
    "h": (
        "facility",
        """h AS (SELECT *, TRY_CAST(overall_rating AS DOUBLE) AS stars,
  TRY_CAST(count_mort_measures_worse AS BIGINT) AS mort, TRY_CAST(count_safety_measures_worse AS BIGINT) AS safety,
  TRY_CAST(count_readm_measures_worse AS BIGINT) AS readm, TRY_CAST(count_safety_measures_better AS BIGINT) AS safety_good,
  coalesce(TRY_CAST(count_mort_measures_worse AS BIGINT),0) + coalesce(TRY_CAST(count_safety_measures_worse AS BIGINT),0)
   + coalesce(TRY_CAST(count_readm_measures_worse AS BIGINT),0) AS risk
 FROM facility)""",
    ),
    "t": ("timely", "t AS (SELECT *, TRY_CAST(score AS DOUBLE) AS points FROM timely)"),
    "s": (
        "survey",
        """s AS (SELECT *, TRY_CAST(patient_survey_star_rating AS DOUBLE) AS star,
  TRY_CAST(survey_response_rate_percent AS INTEGER) AS rate, TRY_CAST(number_of_completed_surveys AS INTEGER) AS done,
  TRY_CAST(hcahps_answer_percent AS DOUBLE) AS pct,
  strptime(start_date,'%m/%d/%Y') AS d1, strptime(end_date,'%m/%d/%Y') AS d2 FROM survey)""",
    ),
}


def up(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,9)),{n}) AS DOUBLE)"


def even(x: str, n: int) -> str:
    return f"CAST(round_even(CAST({x} AS DECIMAL(28,9)),{n}) AS DOUBLE)"


def over(tables: str, body: str) -> str:
    """Statement over typed tables named by letter; ``body`` may start with more CTEs."""
    bases = ctes(*[_TYPED[k][0] for k in tables])
    typed = ",\n".join(_TYPED[k][1] for k in tables)
    lead = "," if body.lstrip().startswith("@") else ""
    return f"WITH {bases},\n{typed}{lead}\n{body.lstrip().lstrip('@')}"


def _mean_by(by: str, alias: str, having: str = "", digits: int = 2) -> str:
    return over("h", f"SELECT {by}, {up('avg(stars)', digits)} AS {alias} FROM h WHERE stars IS NOT NULL GROUP BY {by} {having}")


def _listing(where: str, column: str) -> str:
    return over("h", f"SELECT facility_name, city_town, state, {column} FROM h WHERE {where}")


def _bottom(n: int) -> str:
    return over(
        "h",
        f"""@ordered AS (SELECT h.*, row_number() OVER (PARTITION BY state ORDER BY stars, facility_name, facility_id) AS k
 FROM h WHERE stars IS NOT NULL)
SELECT state, facility_name, city_town, county_parish, overall_rating FROM ordered WHERE k <= {n}""",
    )


def catalogue() -> dict[str, str]:
    q: dict[str, str] = {}
    # geography
    q["q01"] = over("h", "SELECT facility_name, city_town, state, overall_rating FROM h WHERE lower(state) = 'nation_3'")
    q["q02"] = over("h", "SELECT DISTINCT state FROM h")
    q["q03"] = over("h", "SELECT facility_name, city_town, county_parish, state, overall_rating FROM h WHERE stars = 1")
    q["q04"] = over(
        "h",
        "SELECT facility_name, city_town, county_parish, hospital_type, hospital_ownership FROM h"
        " WHERE lower(county_parish) = 'nation_3 county 1'",
    )
    q["q05"] = over(
        "h",
        "SELECT facility_name, city_town, overall_rating FROM h WHERE state = 'NATION_3' AND stars IS NOT NULL"
        " ORDER BY stars DESC, facility_name, facility_id LIMIT 20",
    )
    q["q06"] = over("h", "SELECT state, count(*) AS total_hospitals FROM h GROUP BY state")
    q["q07"] = _mean_by("state", "average_rating", digits=6)
    q["q08"] = over(
        "h",
        "SELECT state, min(county_parish) AS county_parish, count(*) AS low_rated_hospitals FROM h"
        " WHERE stars <= 3 GROUP BY state, lower(county_parish) HAVING count(*) > 5",
    )
    q["q09"] = over(
        "h",
        "SELECT state, count(*) FILTER (emergency_services = 'Yes') AS emergency_hospitals,"
        " count(*) FILTER (emergency_services = 'No') AS non_emergency_hospitals FROM h GROUP BY state",
    )
    q["q10"] = over("h", "SELECT state, count(*) AS hospital_count FROM h WHERE mort > 0 GROUP BY state")
    q["q11"] = over(
        "h",
        f"""@m AS (SELECT state, avg(stars) AS a FROM h WHERE stars IS NOT NULL GROUP BY state)
SELECT state, {up('a', 2)} AS average_rating, rank() OVER (ORDER BY a DESC) AS state_rank FROM m""",
    )
    q["q12"] = _bottom(1)
    q["q13"] = over(
        "h",
        f"""@c AS (SELECT state, min(county_parish) AS county_parish, avg(stars) AS a FROM h WHERE stars IS NOT NULL
 GROUP BY state, lower(county_parish))
SELECT county_parish, state, {up('a', 2)} AS county_average_rating FROM c WHERE a < (SELECT avg(stars) FROM h)""",
    )
    q["q14"] = over(
        "h",
        f"SELECT state, count(*) AS total_hospitals, {up('avg(stars)', 2)} AS average_rating FROM h"
        " WHERE stars IS NOT NULL GROUP BY state",
    )
    q["q15"] = _bottom(3)
    # ownership
    q["q16"] = over("h", "SELECT facility_name, hospital_type, hospital_ownership FROM h")
    q["q17"] = over("h", "SELECT DISTINCT hospital_ownership FROM h")
    q["q18"] = _listing("hospital_ownership = 'Government - State'", "hospital_ownership")
    q["q19"] = _listing("hospital_type = 'Critical Access Hospitals'", "hospital_type")
    q["q20"] = _listing("emergency_services = 'No'", "emergency_services")
    q["q21"] = over("h", "SELECT hospital_ownership, count(*) AS total_hospitals FROM h GROUP BY ALL")
    q["q22"] = _mean_by("hospital_type", "average_rating")
    q["q23"] = _mean_by("hospital_ownership", "average_rating", "HAVING avg(stars) > 2.9")
    q["q24"] = over(
        "h",
        "SELECT hospital_ownership, count(*) AS birthing_friendly_hospitals FROM h WHERE birthing_friendly = 'Y' GROUP BY ALL",
    )
    q["q25"] = over(
        "h",
        f"""SELECT CASE WHEN hospital_ownership = 'Proprietary' THEN 'For-Profit'
 WHEN hospital_ownership LIKE 'Voluntary non-profit - %' THEN 'Non-Profit' ELSE 'Other' END AS ownership_category,
 {up('avg(mort)', 2)} AS avg_mortality_measures FROM h GROUP BY 1""",
    )
    q["q26"] = over(
        "h",
        f"""@m AS (SELECT hospital_ownership, avg(stars) AS a FROM h WHERE stars IS NOT NULL GROUP BY ALL)
SELECT hospital_ownership, {up('a', 2)} AS average_rating, rank() OVER (ORDER BY a DESC) AS ownership_rank FROM m""",
    )
    q["q27"] = over(
        "h",
        f"""@z AS (SELECT hospital_ownership, count(*) AS total_hospitals, count(*) FILTER (safety = 0) AS zero_safety_hospitals
 FROM h GROUP BY ALL)
SELECT *, {up('100.0 * zero_safety_hospitals / total_hospitals', 2)} AS percentage_zero_safety FROM z""",
    )
    q["q28"] = over(
        "h",
        f"""SELECT hospital_type, hospital_ownership, count(*) AS total_hospitals, {up('avg(stars)', 2)} AS average_rating,
 {up("100.0 * count(*) FILTER (emergency_services = 'Yes') / count(*)", 2)} AS emergency_service_percentage
 FROM h WHERE stars IS NOT NULL GROUP BY ALL""",
    )
    q["q29"] = over(
        "h",
        f"""@m AS (SELECT hospital_type, hospital_ownership, avg(stars) AS a FROM h WHERE stars IS NOT NULL GROUP BY ALL)
SELECT hospital_type, hospital_ownership, {up('a', 2)} AS average_rating FROM m
QUALIFY row_number() OVER (PARTITION BY hospital_type ORDER BY a DESC, hospital_ownership) = 1""",
    )
    q["q30"] = over(
        "h",
        f"""@m AS (SELECT hospital_ownership, avg(stars) AS a FROM h WHERE stars IS NOT NULL GROUP BY ALL),
 n AS (SELECT avg(stars) AS b FROM h)
SELECT hospital_ownership, {up('a', 2)} AS average_rating, {up('b', 2)} AS national_average FROM m, n WHERE a < b""",
    )
    # safety
    q["q31"] = over("h", "SELECT facility_name, state, count_mort_measures_worse, count_safety_measures_worse FROM h")
    q["q32"] = _listing("readm > 0", "count_readm_measures_worse")
    q["q33"] = _listing("mort = 0", "count_mort_measures_worse")
    q["q34"] = _listing("safety_good > 2", "count_safety_measures_better")
    three = "count_mort_measures_worse, count_safety_measures_worse, count_readm_measures_worse"
    q["q35"] = _listing("mort = 0 AND safety = 0 AND readm = 0", three)

    def mean_worse(value: str, by: str, alias: str, where: str = "true") -> str:
        return over("h", f"SELECT {by}, {up(f'avg({value})', 2)} AS {alias} FROM h WHERE {where} GROUP BY {by}")

    q["q36"] = mean_worse("mort", "state", "avg_mortality_measures")
    q["q37"] = over("h", "SELECT hospital_type, count(*) AS total_hospitals FROM h WHERE readm > 0 GROUP BY ALL")
    q["q38"] = mean_worse("safety", "overall_rating", "avg_safety_measures_worse", "stars IS NOT NULL")
    q["q39"] = over("h", "SELECT state, count(*) AS total_hospitals FROM h WHERE mort > 0 GROUP BY state HAVING count(*) > 10")
    q["q40"] = mean_worse("readm", "emergency_services", "avg_readmission_measures")
    q["q41"] = over(
        "h",
        f"SELECT facility_name, state, {three}, risk AS total_risk_score, rank() OVER (ORDER BY risk DESC) AS national_rank FROM h",
    )
    q["q42"] = over(
        "h",
        """@d AS (SELECT state, ntile(10) OVER (ORDER BY risk DESC, facility_id) AS g FROM h)
SELECT state, count(*) AS high_risk_hospitals FROM d WHERE g = 1 GROUP BY state""",
    )
    q["q43"] = over("h", f"SELECT facility_id, facility_name, state, {three}, risk AS composite_risk_score FROM h")
    q["q44"] = over(
        "h",
        """SELECT state, facility_name, risk AS risk_score FROM h WHERE coalesce(mort, safety, readm) IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY state ORDER BY risk DESC, facility_name, facility_id) = 1""",
    )
    q["q45"] = over(
        "h",
        "SELECT facility_name, state, count_safety_measures_worse FROM h WHERE safety > (SELECT avg(safety) FROM h)",
    )
    # timeliness
    q["q46"] = over("t", "SELECT facility_name, measure_name, score FROM t WHERE facility_name = 'Customer#000000001'")
    q["q47"] = over(
        "t",
        "SELECT facility_name, state, condition_name, measure_name, score FROM t"
        " WHERE condition_name = 'Emergency Department' AND points IS NOT NULL",
    )
    q["q48"] = over("t", "SELECT DISTINCT condition_name FROM t")
    q["q49"] = over(
        "t",
        "SELECT facility_name, state, measure_name, score FROM t"
        " WHERE condition_name = 'Healthcare Personnel Vaccination' AND points = 100",
    )
    q["q50"] = over(
        "t",
        "SELECT facility_name, state, measure_name, score FROM t"
        " WHERE measure_id = 'OP_23' AND (score IS NULL OR lower(score) = 'not available')",
    )
    q["q51"] = over("t", f"SELECT measure_name, {up('avg(points)', 2)} AS average_score FROM t WHERE points IS NOT NULL GROUP BY ALL")
    q["q52"] = over("t", f"SELECT condition_name, {up('avg(points)', 2)} AS average_score FROM t WHERE points IS NOT NULL GROUP BY ALL")
    q["q53"] = over(
        "t",
        "SELECT measure_id, count(DISTINCT facility_id) AS total_hospitals FROM t"
        " WHERE lower(score) <> 'not available' GROUP BY ALL",
    )
    q["q54"] = over(
        "ht",
        f"""SELECT h.state, {up('avg(points)', 2)} AS average_score FROM t JOIN h USING (facility_id)
 WHERE condition_name = 'Emergency Department' AND points IS NOT NULL GROUP BY h.state""",
    )
    q["q55"] = over(
        "ht",
        f"""SELECT h.state, {up('avg(points)', 2)} AS state_average FROM t JOIN h USING (facility_id)
 WHERE measure_id = 'IMM_3' AND points IS NOT NULL GROUP BY h.state
 HAVING avg(points) < (SELECT avg(points) FROM t WHERE measure_id = 'IMM_3')""",
    )
    q["q56"] = over(
        "ht",
        """SELECT h.state, t.facility_name, measure_id, points AS score,
 row_number() OVER (PARTITION BY h.state ORDER BY points DESC, t.facility_name, facility_id) AS state_rank
 FROM t JOIN h USING (facility_id) WHERE measure_id = 'IMM_3' AND points IS NOT NULL""",
    )
    q["q57"] = over(
        "ht",
        """SELECT facility_id, t.facility_name, h.state, hospital_ownership, condition_name, measure_id, measure_name, score,
 start_date, end_date FROM t JOIN h USING (facility_id)""",
    )
    q["q58"] = over(
        "t",
        """SELECT facility_name, state, points AS score,
 CASE ntile(10) OVER (ORDER BY points, facility_id) WHEN 1 THEN 'Bottom 10%' ELSE 'Other' END AS performance
 FROM t WHERE measure_id = 'IMM_3' AND points IS NOT NULL""",
    )
    q["q59"] = over(
        "t",
        """@m AS (SELECT condition_name, start_date, end_date, avg(points) AS avg_score FROM t WHERE points IS NOT NULL GROUP BY ALL),
 p AS (SELECT *, lag(avg_score) OVER (PARTITION BY condition_name
   ORDER BY strptime(start_date,'%m/%d/%Y'), strptime(end_date,'%m/%d/%Y')) AS previous_score FROM m)
SELECT *, avg_score - previous_score AS score_change FROM p""",
    )
    q["q60"] = over(
        "ht",
        """SELECT overall_rating, avg(points) AS avg_timely_score FROM t JOIN h USING (facility_id)
 WHERE stars IS NOT NULL AND points IS NOT NULL GROUP BY overall_rating""",
    )
    # experience
    q["q61"] = over(
        "s",
        "SELECT facility_name, hcahps_question, hcahps_answer_description, hcahps_answer_percent FROM s"
        " WHERE facility_name = 'Customer#000000001'",
    )
    q["q62"] = over(
        "s",
        "SELECT facility_name, state, hcahps_measure_id, patient_survey_star_rating FROM s"
        " WHERE hcahps_measure_id = 'H_STAR_RATING' AND star = 5",
    )
    q["q63"] = over("s", "SELECT DISTINCT hcahps_question FROM s")
    q["q64"] = over("s", "SELECT DISTINCT facility_name, state, survey_response_rate_percent FROM s WHERE rate < 20")
    q["q65"] = over(
        "s",
        """SELECT facility_name, state, max(done) AS completed_surveys FROM s WHERE done IS NOT NULL GROUP BY ALL
 ORDER BY completed_surveys DESC, facility_name, state LIMIT 15""",
    )

    def star_by(column: str) -> str:
        return over(
            "hs",
            f"SELECT h.{column}, {up('avg(star)', 2)} AS avg_star_rating FROM s JOIN h USING (facility_id)"
            f" WHERE star IS NOT NULL GROUP BY h.{column}",
        )

    q["q66"] = star_by("state")
    q["q67"] = over("s", f"SELECT hcahps_measure_id, {up('avg(pct)', 2)} AS avg_answer_percent FROM s WHERE pct IS NOT NULL GROUP BY ALL")
    q["q68"] = over(
        "hs",
        """SELECT hospital_ownership, count(DISTINCT facility_id) AS low_response_hospitals
 FROM s JOIN h USING (facility_id) WHERE rate < 30 GROUP BY ALL""",
    )
    q["q69"] = star_by("emergency_services")
    q["q70"] = over(
        "hs",
        """@m AS (SELECT facility_id, h.state, avg(star) AS a FROM s JOIN h USING (facility_id) WHERE star IS NOT NULL GROUP BY ALL)
SELECT state, count(*) AS low_rated_hospitals FROM m WHERE a < 3 GROUP BY state HAVING count(*) > 20""",
    )
    q["q71"] = over(
        "hs",
        f"""@m AS (SELECT facility_id, avg(star) AS a FROM s WHERE star IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN risk >= 3 THEN 'High Risk' WHEN risk IN (1, 2) THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_category,
 count(*) AS total_hospitals, {up('avg(a)', 2)} AS avg_patient_star_rating FROM h JOIN m USING (facility_id) GROUP BY 1""",
    )
    q["q72"] = over(
        "hs",
        f"""@m AS (SELECT facility_id, s.facility_name, h.state, avg(star) AS a FROM s JOIN h USING (facility_id)
 WHERE star IS NOT NULL GROUP BY ALL)
SELECT state, facility_name, {up('a', 2)} AS avg_star_rating FROM m
QUALIFY row_number() OVER (PARTITION BY state ORDER BY a DESC, facility_name, facility_id) = 1""",
    )
    q["q73"] = over(
        "hs",
        f"""SELECT facility_id, s.facility_name, h.state, hospital_ownership, {up('avg(star)', 2)} AS avg_star_rating,
 max(rate) AS response_rate_percent, max(done) AS completed_surveys FROM s JOIN h USING (facility_id) GROUP BY ALL""",
    )
    q["q74"] = over(
        "s",
        """@m AS (SELECT facility_id, facility_name, start_date, end_date, d1, d2, max(rate) AS response_rate FROM s
 WHERE rate IS NOT NULL GROUP BY ALL),
 p AS (SELECT *, lag(response_rate) OVER (PARTITION BY facility_id ORDER BY d1, d2) AS previous_response_rate FROM m)
SELECT facility_name, start_date, end_date, response_rate, previous_response_rate,
 response_rate - previous_response_rate AS response_rate_change FROM p""",
    )
    q["q75"] = over(
        "hts",
        f"""@a AS (SELECT facility_id, avg(points) AS tm FROM t WHERE points IS NOT NULL GROUP BY ALL),
 b AS (SELECT facility_id, avg(star) AS sm FROM s WHERE star IS NOT NULL GROUP BY ALL),
 c AS (SELECT facility_name, state, risk AS composite_risk_score, {up('tm', 2)} AS avg_timely_score,
  {up('sm', 2)} AS avg_star_rating, {up('sm * 20 + tm - risk * 10', 2)} AS overall_score
  FROM h JOIN a USING (facility_id) JOIN b USING (facility_id))
SELECT *, rank() OVER (ORDER BY overall_score DESC) AS national_rank FROM c""",
    )
    return q

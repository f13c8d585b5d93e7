"""Feature table, labels per release, panel and trends on small hand-made data."""

import pytest
from conftest import N_PROVIDERS, feature_rows
from pyspark.sql import functions as F

from wardlens.plans import features as f
from wardlens.plans import panel, trends
from wardlens.sources import profiling, snapshots
from wardlens.sources.schemas import FEATURES

GENERAL = "row_seq int, period string, `Facility ID` string, `Facility Name` string, State string, `County Name` string, " \
    "`Hospital Type` string, `Hospital Ownership` string, `Emergency Services` string, `Hospital overall rating` string, " \
    "`Count of MORT Measures Worse` string, `Count of Safety Measures Worse` string, `Count of READM Measures Worse` string"


@pytest.fixture(scope="module")
def raw(spark):
    def row(seq, period, fid, name, rating, *worse):
        return (seq, period, fid, name, "CA", " Kern ", "Acute", "Proprietary", "Yes", rating, *worse)

    na = "Not Available"
    general = spark.createDataFrame(
        [
            row(2, "2021-01-27", "010001", "second", "1", "1", "0", "0"),
            row(1, "2021-01-27", " 010001", "first", "5", na, na, na),
            row(3, "2021-01-27", "010002", "b", "2", na, na, ""),
            row(4, "2021-04-28", "010001", "first", "4", "0", "1", na),
            row(5, "2021-04-28", "010002", "b", na, na, na, na),
        ],
        GENERAL,
    )
    survey = spark.createDataFrame(
        [("2021-01-27", "010001", "4", "30", "100"), ("2021-01-27", "010001 ", "5", "31", "90"),
         ("2021-01-27", None, "1", "99", "1"), ("2021-04-28", "010002", na, na, "7")],
        "period string, `Facility ID` string, `Patient Survey Star Rating` string, `Survey Response Rate Percent` string, "
        "`Number of Completed Surveys` string",
    )
    timely = spark.createDataFrame(
        [("2021-01-27", "010001", "100"), ("2021-01-27", "010001", "0"), ("2021-01-27", "010001", "101"),
         ("2021-04-28", "010002", "150")],
        "period string, `Facility ID` string, Score string",
    )
    return general, survey, timely


def test_first_row_of_a_repeated_id_stays(raw):
    got = f.load_general(raw[0].filter("period = '2021-01-27'")).orderBy("facility_id").collect()
    assert [(r.facility_id, r.facility_name, r.county, r.overall_rating) for r in got] == [
        ("010001", "first", "Kern", 5.0), ("010002", "b", "Kern", 2.0)]


def test_assembled_per_release(raw):
    keys = f.PER_RELEASE
    got = f.assemble(f.load_general(raw[0], keys), f.load_hcahps(raw[1], keys), f.load_timely(raw[2], keys), keys)
    rows = {(r.period, r.facility_id): r for r in got.collect()}
    assert len(rows) == 4
    first = rows["2021-01-27", "010001"]
    assert (first.patient_star_avg, first.survey_response_rate, first.completed_surveys, first.timely_care_avg) == (4.5, 31.0, 100.0, 50.0)
    # No hospital has counts in the first release: composite unknown, label still from the rating.
    assert first.composite_risk_score is None and first.is_underperformer == 0
    assert rows["2021-01-27", "010002"].is_underperformer == 1
    assert rows["2021-04-28", "010001"].composite_risk_score == 1.0
    # In a release with counts a hospital without any has 0.
    late = rows["2021-04-28", "010002"]
    assert late.composite_risk_score == 0.0 and late.is_underperformer == 0
    assert late.timely_care_avg is None and late.patient_star_avg is None and late.completed_surveys == 7.0


def test_release_without_county_and_counts(raw):
    bare = raw[0].drop("County Name", "Count of MORT Measures Worse", "Count of Safety Measures Worse", "Count of READM Measures Worse")
    got = f.with_targets(f.load_general(bare.drop("period"))).collect()
    assert {(r.county, r._mort_worse, r.composite_risk_score) for r in got} == {("", None, None)}


def _two_releases(spark):
    def release(label, rise):
        rows = [(*r[:11], r[11] + rise, *r[12:]) for r in feature_rows()]
        return spark.createDataFrame(rows, FEATURES).withColumn("period", F.lit(label))

    return [release("2023-A", 0.0), release("2023-B", -0.25), release("2023-C", 0.5)]


def test_panel_deltas(spark):
    got = panel.build_panel(_two_releases(spark))
    steps = {}
    for r in got.collect():
        steps.setdefault(r.period, []).append(r.patient_star_avg_delta)
    assert {p: len(v) for p, v in steps.items()} == dict.fromkeys(("2023-A", "2023-B", "2023-C"), N_PROVIDERS)
    for period, change in (("2023-A", None), ("2023-B", -0.25), ("2023-C", 0.75)):
        assert {None if d is None else round(d, 9) for d in steps[period]} == {change}


def test_panel_without_releases_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        panel.build_panel([])
    with pytest.raises(FileNotFoundError):
        snapshots.load_snapshots(spark, str(tmp_path / "nope"))


def test_delta_is_against_the_previous_row_not_the_previous_release(spark):
    df = spark.createDataFrame([("a", "1", 1.0), ("a", "3", 4.0), ("b", "1", None), ("b", "2", 2.0)],
                               "facility_id string, period string, overall_rating double")
    got = {(r.facility_id, r.period): r.overall_rating_delta for r in panel.add_deltas(df).collect()}
    assert got == {("a", "1"): None, ("a", "3"): 3.0, ("b", "1"): None, ("b", "2"): None}


def _panel(spark, stars, risks):
    rows = [("h", f"P{i}", f"name {i}", None if i == len(stars) - 1 else "CA", s, r) for i, (s, r) in enumerate(zip(stars, risks))]
    return spark.createDataFrame(
        rows, "facility_id string, period string, facility_name string, state string, patient_star_avg double, composite_risk_score double")


def test_slope_of_a_known_line(spark):
    row = trends.slopes(_panel(spark, [2.0, 3.0, 4.0, 5.0], [None] * 4)).first()
    assert (row.satisfaction_slope, row.risk_slope) == (1.0, None)


def test_slope_needs_two_points(spark):
    row = trends.slopes(_panel(spark, [None, 5.0, None], [1.0, None, 3.0])).first()
    assert (row.satisfaction_slope, row.risk_slope) == (None, 1.0)


@pytest.mark.parametrize(
    "stars, risks, flag",
    [([3.0, 2.96], [0.0, 0.0], 1), ([3.0, 2.98], [0.0, 0.0], 0), ([3.0, 4.0], [0.0, 0.06], 1), ([None, 3.0], [1.0, None], 0)],
)
def test_early_warning(spark, stars, risks, flag):
    row = trends.early_warning(_panel(spark, stars, risks)).first()
    assert row.declining_trajectory == flag
    assert row.facility_name == "name 1" and row.state is None  # the last row counts, also when its value is missing


def test_indexed_trends_start_at_100(spark):
    nat = spark.createDataFrame([("1", 2.0, 50.0), ("2", 3.0, 25.0)], "period string, patient_star_avg double, timely_care_avg double")
    got = trends.indexed_trends(nat).collect()
    assert [tuple(r) for r in got] == [("1", 100.0, 100.0), ("2", 150.0, 50.0)]


def test_panel_summary_marks_simulated_periods(spark):
    df = spark.createDataFrame([("a", "SIM-1"), ("b", "2021")], "facility_id string, period string")
    assert tuple(profiling.panel_summary(df).first()) == (2, 2, 2, 1)


def test_max_lengths_and_coverage(spark):
    df = spark.createDataFrame([("abc", None), ("", None)], "a string, b string")
    assert [tuple(r) for r in profiling.max_lengths(df).orderBy("position").collect()] == [(1, "a", 3), (2, "b", 0)]
    assert {tuple(r) for r in profiling.coverage(df).collect()} == {("a", 100.0), ("b", 0.0)}

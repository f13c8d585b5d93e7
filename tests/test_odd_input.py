"""Inputs that once aborted a query, gave random rows or slipped through."""

from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from wardlens.functions import clean, rounding
from wardlens.models import candidates
from wardlens.operators import grouping
from wardlens.plans import features
from wardlens.sources import archives, delimited


def test_large_numbers_pass_rounding(spark):
    df = spark.createDataFrame([(1e25,), (-3e30,), (2.345,), (None,), (float("nan"),)], "c double")
    got = [r[0] for r in df.select(rounding.half_up("c", 2)).collect()]
    assert got[:4] == [1e25, -3e30, 2.35, None] and got[4] != got[4]
    assert df.where("c = 1e25").select(rounding.half_even("c", 3)).first()[0] == 1e25


def test_numbers_beyond_a_double_are_missing(spark):
    df = spark.createDataFrame([("1e400",), ("-1e400",), ("1e300",)], "c string")
    assert [r[0] for r in df.select(clean.to_num("c")).collect()] == [None, None, 1e300]


def test_files_with_other_headings_match_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Facility ID,State\n1,TX\n2,CA\n")
    (tmp_path / "b.csv").write_text("State,Facility ID,More\nNY,3,x\n")
    (tmp_path / "c.csv").write_bytes("Facility ID,State\n4,\xd1\n".encode("latin-1"))
    rows = delimited.read_release_csv(spark, str(tmp_path)).collect()
    assert {(r["Facility ID"], r["State"]) for r in rows} == {("1", "TX"), ("2", "CA"), ("3", "NY"), ("4", "\xd1")}
    assert {k: len(v) for k, v in delimited.file_encodings(spark, str(tmp_path)).items()} == {"UTF-8": 2, "ISO-8859-1": 1}


def test_release_needs_all_three_tables():
    general, survey = (f for t, f in archives.RELEASE_FILES.items() if t in ("general", "survey"))

    def members(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name in names:
                z.writestr(name, "x")
        return archives._members(zipfile.ZipFile(out))

    assert members(f"a/{general}", f"b/{general}", survey) == {}
    assert set(members(*archives.RELEASE_FILES.values())) == set(archives.RELEASE_FILES)


def test_repeated_and_blank_ids(spark):
    rows = [("1", "zeta"), ("1", "alpha"), (" ", "blank"), ("2", "beta")]
    raw = spark.createDataFrame(rows, "facility_id string, facility_name string")
    for parts in (1, 8):
        got = {(r.facility_id, r.facility_name) for r in features.load_general(raw.repartition(parts)).collect()}
        assert got == {("1", "alpha"), ("2", "beta"), (None, "blank")}
    survey = spark.createDataFrame([("", "3"), ("1", "4")], "facility_id string, patient_survey_star_rating string")
    assert [r.facility_id for r in features.load_hcahps(survey).collect()] == ["1"]


def test_groups_ignore_letter_case(spark):
    h = spark.createDataFrame([("CA", "4"), ("ca", "2"), ("TX", "5"), (None, "1")], "state string, overall_rating string")
    assert {tuple(r) for r in grouping.count_by(h, "state").collect()} == {("CA", 2), ("TX", 1), (None, 1)}
    assert {tuple(r) for r in grouping.avg_rating_by(h, "state").collect()} == {("CA", 3.0), ("TX", 5.0), (None, 1.0)}


def test_constant_needs_a_label(spark):
    empty = spark.createDataFrame([], "label double")
    for kind in (True, False):
        with pytest.raises(ValueError, match="at least one training row"):
            candidates.Constant(kind).fit(empty)
    fitted = candidates.Constant(False).fit(empty.union(spark.range(1).select(F.lit(2.5))))
    assert fitted.transform(spark.range(2).withColumn("label", F.lit(0.0))).first()["prediction"] == 2.5

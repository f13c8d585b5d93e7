"""Releases are replaced one by one; a broken write is never seen."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wardlens.sources import release_store

SCHEMA = "facility_id string, v double, period string"


def rows(df):
    return sorted(map(tuple, df.select("facility_id", "v", "period").collect()), key=str)


@pytest.fixture()
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    first = [("a", 1.0, "2020-01-01"), ("b", 2.0, "2020-01-01"), ("a", 3.0, "2021-01-01"), ("a", None, "01")]
    release_store.write_releases(spark.createDataFrame(first, SCHEMA), path)
    return path


def test_one_release_is_replaced(spark, store):
    before = release_store.read_releases(spark, store)
    assert rows(before) == [("a", 1.0, "2020-01-01"), ("a", 3.0, "2021-01-01"), ("a", None, "01"), ("b", 2.0, "2020-01-01")]
    files = set(before.inputFiles())
    release_store.write_releases(spark.createDataFrame([("c", 9.0, "2020-01-01")], SCHEMA), store)
    after = release_store.read_releases(spark, store)
    assert rows(after) == [("a", 3.0, "2021-01-01"), ("a", None, "01"), ("c", 9.0, "2020-01-01")]
    assert files < set(after.inputFiles())  # the other releases lie where they lay
    assert rows(after.filter("period = '2021-01-01'")) == [("a", 3.0, "2021-01-01")]


def test_a_broken_write_is_not_seen(spark, store):
    before = rows(release_store.read_releases(spark, store))
    bad = spark.createDataFrame([("x", 1.0, "2020-01-01"), ("y", 2.0, "2022-01-01")], SCHEMA)
    failing = bad.withColumn("v", F.when(F.col("facility_id") == "y", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        release_store.write_releases(failing, store)
    with pytest.raises(PySparkException):
        release_store.write_releases(bad.withColumn("period", F.lit(None).cast("string")), store)
    bad.write.partitionBy("period").parquet(f"{store}/data/write=lost")  # ended before its manifest row
    assert rows(release_store.read_releases(spark, store)) == before


def test_new_columns_and_no_rows(spark, store):
    wide = spark.createDataFrame([("d", 4.0, "2022-01-01", "new")], SCHEMA + ", extra string")
    release_store.write_releases(wide, store)
    release_store.write_releases(wide.filter("false"), store)
    got = release_store.read_releases(spark, store)
    assert got.count() == 5
    assert got.filter("extra IS NOT NULL").first().facility_id == "d"


def test_an_empty_store_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        release_store.read_releases(spark, str(tmp_path / "none"))

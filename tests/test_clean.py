"""Cleaning, label and rounding rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from wardlens.functions import clean, periods, rounding


def column(spark, values, dtype="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {dtype}")


def got(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_numbers_kept_and_missing_words_null(spark):
    df = column(spark, [" 7\t", None, "*", "-12.75", "NA", "0041", "Not Applicable", "6e2", "", "N/A", "Not Available"])
    assert got(df, clean.to_num("c")) == [7.0, None, None, -12.75, None, 41.0, None, 600.0, None, None, None]


def test_words_a_jvm_double_cast_accepts_are_missing(spark):
    df = column(spark, ["NaN", "Infinity", "-inf", "5d", "5f", "0x1p3", "1e2", "-.5", "3.", "1e", "+4"])
    assert got(df, clean.to_num("c")) == [None] * 6 + [100.0, -0.5, 3.0, None, 4.0]


def test_decimal_text_is_not_an_int(spark):
    df = column(spark, ["3", "3.0", "x", "2147483648"])
    assert got(df, clean.num("c", "int")) == [3, None, None, None]


def test_rating_has_one_decimal(spark):
    df = column(spark, ["4", "3.44", "not available", "100"])
    assert got(df, clean.rating(column="c")) == [4.0, 3.4, None, None]


def test_text_comparison_ignores_case_and_outer_blanks(spark):
    df = column(spark, ["Los Angeles", "LOS ANGELES ", "los angeles", "Los  Angeles", None])
    assert got(df, clean.same_text("c", "Los Angeles")) == [True, True, True, False, None]


def test_is_missing(spark):
    df = column(spark, ["not available", None, "", "4", "*"])
    assert got(df, clean.is_missing("c")) == [True, True, True, False, True]


def test_label(spark):
    df = spark.createDataFrame([(0, 1.0, 0), (1, 2.0, 0), (2, 3.0, 2), (3, 5.0, 0), (4, 4.0, 0), (5, None, 0), (6, None, 1)],
                               "i int, rating double, worse int")
    assert got(df, clean.underperformer_flag("rating", "worse")) == [1, 1, 1, 0, 0, 0, 1]


def test_yes_flag(spark):
    assert got(column(spark, ["Yes", " Yes ", "No", None, "yes"]), clean.yes_flag("c")) == [1, 1, 0, 0, 0]


def test_composite_counts_missing_as_zero(spark):
    df = spark.createDataFrame([("1", "Not Available", "2"), (None, "", "x")], ",".join(f"{c} string" for c in clean.WORSE_COUNTS.values()).replace(",", ", "))
    assert [r[0] for r in df.select(clean.composite_risk()).collect()] == [3, 0]


def test_pick_takes_the_first_existing_name(spark):
    df = spark.createDataFrame([("a", "b")], "`County Name` string, Other string")
    row = df.select(clean.pick(df, "County/Parish", "County Name").alias("x"), clean.pick(df, "none").alias("y"),
                    clean.pick_num(df, "none").alias("z")).first()
    assert tuple(row) == ("a", None, None)


def test_rounding_ties(spark):
    df = column(spark, [2.675, 0.125, 0.375, 2.0000000000001 / 3, -0.125], "double")
    assert got(df, rounding.half_up("c", 2)) == [2.68, 0.13, 0.38, 0.67, -0.13]
    assert got(df, rounding.half_even("c", 2)) == [2.68, 0.12, 0.38, 0.67, -0.12]


@pytest.mark.parametrize(
    "name, period",
    [("hospitals_2021-04-28.zip", "2021-04-28"), ("x/2020-01-01_2021-01-01.zip", "2020-01-01"), ("a/b/spring.zip", "spring"), ("plain", "plain")],
)
def test_period_of(spark, name, period):
    assert got(column(spark, [name]), periods.period_of("c")) == [period]


def test_dates(spark):
    df = column(spark, ["04/30/2021", "2021-04-30", "30/04/2021", None])
    assert [str(v) for v in got(df, periods.parse_date("c"))] == ["2021-04-30", "2021-04-30", "None", "None"]


def test_period_index_follows_text_order(spark):
    df = column(spark, ["2021-10-01", "2021-02-01", "2021-10-01", "2020-12-01"]).withColumnRenamed("c", "period")
    assert [r.t for r in periods.period_index(df).orderBy("i").collect()] == [2, 1, 2, 0]


def test_row_sum_ignores_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(clean.row_sum0(["a", F.col("b")])).collect()] == [1.0, 0.0]


def test_int_and_decimal_casts_need_no_guard(spark):
    df = column(spark, [" 7\t", "\n8 ", "5d", "5f", "NaN", "Infinity", "1e2", "0x1", "", "1_0"])
    assert got(df, clean.num("c", "int")) == [7, 8] + [None] * 8
    ratings = got(df, clean.rating(column="c"))
    assert ratings[:6] == [7.0, 8.0, None, None, None, None] and ratings[7:] == [None] * 3

"""Scale-safe ranking equals the built-in windows, with hot keys and any partition count."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlens.operators import ranking
from wardlens.operators.medians import exact_medians
from wardlens.sources.scratch import materialize


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one group and one score."""
    r = random.Random(7)
    data = []
    for i in range(3001):
        hot = i % 3 == 0
        score = 50.0 if hot else (None if i % 50 == 1 else float(r.randint(0, 400)) / 4)
        data.append((f"{i:05d}", "hot" if hot else r.choice("abcde"), score))
    return spark.createDataFrame(data, "id string, g string, score double").repartition(7).cache()


@pytest.fixture(params=["1", "16"])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("way", ["asc", "desc"])
def test_row_number_rank_ntile(rows, partitions, way):
    key = F.desc_nulls_last("score") if way == "desc" else F.asc_nulls_first("score")
    w = Window.orderBy(key, "id")
    got = ranking.number_rows(rows, [("score", way)], ["id"], out="k")
    same(got.select("id", "k"), rows.select("id", F.row_number().over(w).alias("k")))
    got = ranking.rank_rows(rows, [("score", way)], ["id"], "k")
    same(got.select("id", "k"), rows.select("id", F.rank().over(Window.orderBy(key)).alias("k")))
    got = ranking.rank_by_value(rows, "score", way, "k")
    same(got.select("id", "k"), rows.select("id", F.rank().over(Window.orderBy(key)).alias("k")))
    got = ranking.ntile_rows(rows, 10, [("score", way)], ["id"], "k")
    same(got.select("id", "k"), rows.select("id", F.ntile(10).over(w).alias("k")))


def test_row_number_inside_groups(rows, partitions):
    w = Window.partitionBy("g").orderBy(F.desc_nulls_last("score"), "id")
    got = ranking.number_rows(rows, [("score", "desc")], ["id"], ["g"], "k")
    same(got.select("id", "k"), rows.select("id", F.row_number().over(w).alias("k")))


def test_equal_rows_are_split_over_partitions(spark, monkeypatch):
    """Even rows that agree in every key must not end in one partition."""
    written = []
    monkeypatch.setattr(ranking, "materialize", lambda df, name: written.append(materialize(df, name)) or written[-1])
    same_rows = spark.range(8000).select(F.lit("x").alias("id"), F.lit(1.0).alias("score")).repartition(8)
    placed, total = ranking.place_rows(same_rows, [F.col("score"), F.col("id")])
    assert total == 8000
    assert placed.select("_pos").distinct().count() == 8000
    sizes = written[-1].groupBy(F.shiftright("_id", 33).alias("part")).count().agg(F.max("count")).first()[0]
    assert sizes < 4000


@pytest.mark.parametrize("n, tiles", [(0, 4), (3, 4), (4, 4), (10, 4), (10007, 10)])
def test_tile_formula(spark, n, tiles):
    df = spark.range(1, n + 1)
    w = Window.orderBy("id")
    same(df.select("id", ranking.tile_of("id", n, tiles).alias("k")), df.select("id", F.ntile(tiles).over(w).alias("k")))


def test_running_total_equals_window(rows, partitions):
    counts = rows.filter("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("n"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    plain = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    placed = ranking.running_total(counts, [("score", "asc")], "n", "before")
    same(plain.select("score", "n", "before"), placed.select("score", "n", "before"))


def test_null_safe_join_keeps_null_keys(rows):
    names = rows.groupBy("g").agg(F.max("score").alias("best"))
    w = Window.partitionBy("g")
    same(ranking.join_null_safe(rows, names, ["g"]).select("id", "best"), rows.select("id", F.max("score").over(w).alias("best")))


def test_sort_rows_keeps_all_rows_in_order(rows):
    got = [r.score for r in ranking.sort_rows(rows, F.desc_nulls_last("score")).collect()]
    assert len(got) == 3001
    known = [x for x in got if x is not None]
    assert known == sorted(known, reverse=True) and got[len(known):] == [None] * (3001 - len(known))


def test_top_n_within_limits_before_the_shuffle(rows):
    top = ranking.top_n_within(rows, ["g"], [F.desc("score"), F.asc("id")], 2)
    assert top.count() == 12
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_exact_medians(spark, rows):
    df = rows.withColumn("other", F.when(F.col("g") == "a", F.col("score") * 3)).withColumn("none", F.lit(None).cast("double"))
    found = {r.column_name: (r.n, r.median) for r in exact_medians(df, ["score", "other", "none"]).collect()}
    for c in ("score", "other"):
        values = [r[0] for r in df.select(c).collect() if r[0] is not None]
        assert found[c] == (len(values), statistics.median(values))
    assert "none" not in found


def test_runs_over_many_partition_borders(spark):
    """One key fills several partitions, nulls and NaN are keys of their own, batches are small."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        values = [None] * 90 + [float("nan")] * 70 + [-0.0, 0.0] * 40 + [1.5] * 700 + [float(i // 3) for i in range(200)]
        data = [(i, v, None if i % 7 == 0 else "ab"[i % 2]) for i, v in enumerate(values)]
        df = spark.createDataFrame(data, "id int, v double, g string").repartition(5)
        for way, key in (("asc", F.asc_nulls_first("v")), ("desc", F.desc_nulls_last("v"))):
            got = ranking.rank_rows(df, [("v", way)], ["id"], "k")
            same(got.select("id", "k"), df.select("id", F.rank().over(Window.orderBy(key)).alias("k")))
            got = ranking.number_rows(df, [("v", way)], ["id"], ["g"], "k")
            same(got.select("id", "k"), df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(key, "id")).alias("k")))
            two = ranking.rank_rows(df, [("g", "asc"), ("v", way)], ["id"], "k")
            same(two.select("id", "k"), df.select("id", F.rank().over(Window.orderBy(F.asc_nulls_first("g"), key)).alias("k")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranks_join_on_no_value(rows):
    plan = ranking.rank_rows(rows, [("score", "desc")], ["id"], "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "score#" not in plan.split("BroadcastHashJoin")[1].split("\n")[0]


def test_no_rows_have_no_rank(spark):
    none = spark.createDataFrame([], "id int, v double")
    assert ranking.rank_rows(none, [("v", "desc")], ["id"]).count() == 0
    assert ranking.number_rows(none, [("v", "desc")], ["id"], ["v"]).count() == 0

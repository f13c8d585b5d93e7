"""Trend state: single releases add up to the run over the whole panel."""

import random

import pytest
from pyspark.sql import functions as F

from wardlens.functions.periods import period_index
from wardlens.plans import panel, trend_state, trends

SCHEMA = "facility_id string, period string, facility_name string, state string, " + ", ".join(f"{m} double" for m in panel.METRICS)
LABELS = ["2019-01-01", "2019-07-01", "2020-02-01", "2020-08-01", "2021-03-01"]


@pytest.fixture(scope="module")
def history(spark):
    """Hospitals come and go, values and one id are missing."""
    r = random.Random(5)
    rows = []
    for place, label in enumerate(LABELS):
        for k in range(60):
            if (k + place) % 7 == 0 or (k > 50 and place < 3):
                continue
            values = [None if r.random() < 0.2 else round(r.uniform(0, 5), 3) for _ in panel.METRICS]
            rows.append((None if k == 9 else f"h{k}", label, f"name {k} {place}", None if k % 5 == place else f"S{k % 4}", *values))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def release(history, label):
    return history.filter(F.col("period") == label).drop("period")


@pytest.fixture(scope="module")
def stepwise(spark, history, tmp_path_factory):
    """Every release added on its own, the state stored and read between."""
    state = trend_state.from_panel(history.filter("false"))
    for k, label in enumerate(LABELS):
        path = str(tmp_path_factory.mktemp("state") / str(k))
        trend_state.write(trend_state.add_release(state, release(history, label), label), path)
        state = trend_state.read(spark, path)
    return state


def test_single_releases_equal_the_full_run(history, stepwise):
    assert collected(trend_state.early_warning(stepwise)) == collected(trends.early_warning(history))
    assert collected(trend_state.national_trends(stepwise)) == collected(trends.national_trends(history))
    full = trend_state.from_panel(history)
    assert collected(full.releases.select("period", "t")) == collected(stepwise.releases.select("period", "t"))
    assert collected(trend_state.early_warning(full)) == collected(trends.early_warning(history))


def test_order_of_merging_does_not_matter(history, stepwise):
    timed = period_index(history)
    parts = [trend_state._summed(timed.filter(F.col("period") == label)) for label in LABELS]
    merged = trend_state.merge([parts[3], trend_state.merge([parts[4], parts[0]]), parts[2], parts[1]])
    assert collected(trend_state.early_warning(merged)) == collected(trend_state.early_warning(stepwise))


def test_deltas_of_a_new_release(history):
    state = trend_state.from_panel(history.filter(F.col("period") < LABELS[-1]))
    got = trend_state.release_deltas(state, release(history, LABELS[-1]))
    want = panel.add_deltas(history).filter(F.col("period") == LABELS[-1])
    names = ["facility_id", *[f"{m}_delta" for m in panel.METRICS]]
    assert collected(got.select(*names)) == collected(want.select(*names))


@pytest.mark.parametrize("label", ["2021-03-01", "2020-03-01"])
def test_a_release_between_or_again_is_refused(history, stepwise, label):
    with pytest.raises(ValueError, match="not later"):
        trend_state.add_release(stepwise, release(history, LABELS[0]), label)


def test_a_release_without_a_metric(history, stepwise):
    narrow = release(history, LABELS[0]).drop("composite_risk_score", "timely_care_avg")
    state = trend_state.add_release(stepwise, narrow, "2022-01-01")
    stacked = history.unionByName(narrow.withColumn("period", F.lit("2022-01-01")), allowMissingColumns=True)
    assert collected(trend_state.early_warning(state)) == collected(trends.early_warning(stacked))

"""The booster against a plain one on a single array, grown leaf by leaf."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from wardlens.models import booster
from wardlens.models.booster import Growth


def plain(x, y, rules, cuts):
    """Predictions of boosting by the same rules, one split at a time, on raw values."""
    mean = y.mean()
    raw = np.full(len(y), math.log(mean / (1 - mean)) if rules.classification else mean)
    for _ in range(rules.rounds):
        if rules.classification:
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
        else:
            g, h = raw - y, np.ones(len(y))

        def score(rows):
            return g[rows].sum() ** 2 / max(h[rows].sum() + rules.l2, 1e-12)

        def best(rows, depth):
            found = (0.0, None)
            if depth >= rules.max_depth:
                return found
            for f in range(x.shape[1]):
                missing = np.isnan(x[rows, f])
                for c in cuts[f]:
                    for missing_left in (False, True) if missing.any() else (False,):
                        left = (x[rows, f] <= c) | (missing & missing_left)
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) < rules.min_rows or min(h[a].sum(), h[b].sum()) < rules.min_hessian:
                            continue
                        gain = round(score(a) + score(b) - score(rows), 9)
                        if gain > found[0]:
                            found = (gain, (a, b))
            return found

        leaves = [(np.arange(len(y)), 0)]
        bests = [best(*leaves[0])]
        while len(leaves) < rules.max_leaves and max(b[0] for b in bests) > 0:
            at = max(range(len(leaves)), key=lambda k: bests[k][0])
            (_, (a, b)), (_, depth) = bests.pop(at), leaves.pop(at)
            for part in (a, b):
                leaves.append((part, depth + 1))
                bests.append(best(part, depth + 1))
        for rows, _ in leaves:
            raw[rows] -= rules.rate * g[rows].sum() / max(h[rows].sum() + rules.l2, 1e-12)
    return raw


def data(n, seed, classification, missing):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 3] = rng.integers(0, 2, n)
    signal = x[:, 0] * 2 + np.where(x[:, 1] > 0, x[:, 2], -1) + x[:, 3] + rng.normal(size=n) * 0.3
    if missing:
        x[rng.random((n, 4)) < 0.15] = np.nan
        x[signal > 2, 1] = np.nan  # missing values tell something
    return x, (signal > 0.5).astype(float) if classification else signal


LEAFWISE = {"max_leaves": 7, "min_rows": 5, "rounds": 6}
DEPTHWISE = {"max_leaves": 8, "max_depth": 3, "min_rows": 1, "min_hessian": 1.0, "l2": 1.0, "rate": 0.3, "rounds": 6}


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("classification", [False, True])
@pytest.mark.parametrize("rules", [LEAFWISE, DEPTHWISE])
def test_equals_the_plain_booster(spark, rules, classification, missing):
    rules = Growth(**rules, classification=classification)
    x, y = data(240, 7, classification, missing)
    rows = [(float(t), Vectors.dense(r)) for r, t in zip(x.tolist(), y.tolist())]
    df = spark.createDataFrame(rows, ["label", "features"]).repartition(3)
    model = booster.Booster(rules).fit(df)
    got = model.ensemble.raw(x)
    assert np.allclose(got, plain(x, y, rules, model.ensemble.cuts), atol=1e-7)
    out = model.transform(df).collect()
    assert sorted(round(r.rawPrediction, 9) for r in out) == sorted(round(v, 9) for v in got)
    if classification:
        assert all(r.prediction == (r.rawPrediction > 0) for r in out)


def test_many_models_equal_single_ones(spark):
    """Models grown together are the models grown alone; widths and row numbers may differ."""
    rules = Growth(rounds=4, max_leaves=5, min_rows=4)
    rows, alone = [], {}
    for m, n in enumerate((60, 150, 90)):
        x, y = data(n, m, False, m == 1)
        x = x[:, : 4 - (m == 2)]
        mine = [(m, float(t), Vectors.dense(r)) for r, t in zip(x.tolist(), y.tolist())]
        rows += mine
        alone[m] = x, booster.Booster(rules).fit(spark.createDataFrame(mine, ["m", "label", "features"])).ensemble
    got = booster.fit_many(spark.createDataFrame(rows, ["m", "label", "features"]).repartition(4), rules, "m")
    for m, (x, one) in alone.items():
        assert np.allclose(got[m].raw(x), one.raw(x), atol=1e-9)


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(1)
    values = rng.exponential(size=5000)
    df = spark.createDataFrame([(0, [float(v)]) for v in values], "m int, x array<double>")
    (cuts,) = booster.quantile_cuts(df, 1, "m")[0]
    assert len(cuts) == booster.BINS - 1
    sizes = np.bincount(booster.to_bins(values[:, None], [cuts])[:, 0])
    assert sizes.max() <= 1.3 * 5000 / booster.BINS


def test_without_rows_or_spread(spark):
    flat = spark.createDataFrame([(2.0, Vectors.dense([1.0])) for _ in range(50)], ["label", "features"])
    assert booster.Booster(Growth(rounds=2)).fit(flat).ensemble.raw(np.array([[5.0]])).tolist() == [2.0]
    with pytest.raises(ValueError):
        booster.Booster(Growth()).fit(flat.limit(0))


def test_passes_over_partitions_equal_one_task_and_send_each_node_once(spark, monkeypatch):
    """What reaches the driver does not grow with the number of partitions."""
    x, y = data(300, 5, False, True)
    df = spark.createDataFrame([(float(t), Vectors.dense(r)) for r, t in zip(x.tolist(), y.tolist())], ["label", "features"])
    rules = Growth(rounds=3, max_leaves=6, min_rows=5)
    alone = booster.Booster(rules).fit(df).ensemble
    monkeypatch.setattr(booster, "LOCAL_ROWS", 0)
    assert np.allclose(booster.Booster(rules).fit(df).ensemble.raw(x), alone.raw(x), atol=1e-9)
    bins = booster.to_bins(x, alone.cuts)
    kept = np.zeros((4, booster.BINS + 1), bool)
    kept[:, :200] = kept[:, booster.MISSING] = True
    parts = [{0: (bins[k::6], y[k::6], np.zeros(len(y[k::6])))} for k in range(6)]
    blocks = spark.sparkContext.parallelize(parts, 6)
    got = booster._totals(blocks, {0: booster.Tree()}, {0: [0]}, rules, {0: kept})
    want = booster._sums({0: (bins, y, np.zeros(len(y)))}, {0: booster.Tree()}, {0: [0]}, rules)
    assert np.allclose(got[0], want[0])


def test_splits_are_picked_in_the_tasks(spark):
    """The driver gets a split and six sums for a node, whatever the number of bins."""
    x, y = data(300, 5, True, True)
    rules = Growth(rounds=3, max_leaves=6, min_rows=5, classification=True)
    cuts = [np.unique(c[~np.isnan(c)]) for c in x.T]
    bins = booster.to_bins(x, cuts)
    kept = {0: np.ones((4, booster.BINS + 1), bool)}
    blocks = spark.sparkContext.parallelize([{0: (bins[k::3], y[k::3], np.zeros(len(y[k::3])))} for k in range(3)], 3)
    growers = {0: booster._Grower(rules)}
    ((best, total, left),) = booster._looks(blocks, growers, {0: [0]}, rules, kept)[0]
    want = booster._sums({0: (bins, y, np.zeros(len(y)))}, {0: booster.Tree()}, {0: [0]}, rules)[0][0]
    assert best == booster.best_split(want, rules) and best[0] > 0
    assert np.allclose(total, want[0].sum(axis=0)) and len(total) == len(left) == 3
    assert rules.min_rows <= left[2] <= 300 - rules.min_rows


def mixed_rows(n, seed, classification):
    """Levels of two categories as two-valued features, numbers with missing values, a feature without spread."""
    rng = np.random.default_rng(seed)
    levels = [np.eye(k + 1)[rng.integers(0, k + 1, n)][:, :k] for k in (6, 4)]  # one level has no feature
    numbers = np.round(rng.normal(size=(n, 3)), 1)
    numbers[rng.random((n, 3)) < 0.1] = np.nan
    some = np.where(rng.random(n) < 0.2, np.nan, 1.0)  # one value, or missing
    x = np.column_stack([*levels, numbers, some, np.full(n, 3.0)])
    signal = x[:, 0] * 2 - x[:, 7] + np.nan_to_num(numbers[:, 0], nan=1.5) + rng.normal(size=n) * 0.3
    return x, (signal > 0.3).astype(float) if classification else signal


def equal_to_passes(spark, monkeypatch, rules):
    """A model grown in a task and by passes over the same rows."""
    x, y = mixed_rows(400, 3, rules.classification)
    df = spark.createDataFrame([(float(t), Vectors.dense(r)) for r, t in zip(x.tolist(), y.tolist())], ["label", "features"]).repartition(3)
    alone = booster.Booster(rules).fit(df).ensemble
    monkeypatch.setattr(booster, "LOCAL_ROWS", 0)
    assert np.allclose(booster.Booster(rules).fit(df).ensemble.raw(x), alone.raw(x), atol=1e-9)
    cuts = [np.unique(c[~np.isnan(c)]) for c in x.T]
    bins = booster.to_bins(x, cuts)
    held = booster._Held(bins, y, 0.2, rules)
    assert len(held.keys) < 8 < x.shape[1]  # one pass over the rows for several features
    held.g, held.h = booster._gradients(y, held.raw, rules.classification)
    want = booster._sums({0: (bins, y, held.raw)}, {0: booster.Tree()}, {0: [0]}, rules)[0][0]
    assert np.allclose(held._by_feature(held._count(np.arange(len(y)))), want)


def test_packed_columns_of_a_classifier_give_the_sums_of_all_features(spark, monkeypatch):
    equal_to_passes(spark, monkeypatch, Growth(**DEPTHWISE, classification=True))


def test_each_model_is_boosted_in_a_task_of_its_own(spark, monkeypatch):
    """The bound holds for a model: models that are small each need no pass over all rows."""
    rules = Growth(**LEAFWISE, classification=True)
    rows, alone = [], {}
    for m in (4, 0, 2):
        x, y = data(90, m, True, True)
        mine = [(m, float(t), Vectors.dense(r)) for r, t in zip(x.tolist(), y.tolist())]
        rows += mine
        alone[m] = x, booster.Booster(rules).fit(spark.createDataFrame(mine, ["m", "label", "features"])).ensemble
    monkeypatch.setattr(booster, "LOCAL_ROWS", 100)
    monkeypatch.setattr(booster, "_totals", None)
    got = booster.fit_many(spark.createDataFrame(rows, ["m", "label", "features"]).repartition(5), rules, "m")
    for m, (x, one) in alone.items():
        assert np.allclose(got[m].raw(x), one.raw(x), atol=1e-9)


def test_packed_columns_of_a_regressor_give_the_sums_of_all_features(spark, monkeypatch):
    equal_to_passes(spark, monkeypatch, Growth(**DEPTHWISE))
    rules = Growth(rounds=5, rate=0.05, max_leaves=32, max_depth=5, min_rows=1, min_hessian=1.0, l2=1.0)  # as m_boost400
    x, y = mixed_rows(300, 11, False)
    cuts = [np.unique(c[~np.isnan(c)]) for c in x.T]
    bins, calls = booster.to_bins(x, cuts), []
    held = booster._Held(bins, y, y.mean(), rules)
    monkeypatch.setattr(held, "_count", lambda rows, count=held._count: calls.append(len(rows)) or count(rows))
    trees = list(held.trees())
    ensemble = booster.Ensemble(y.mean(), cuts, trees)
    assert len(trees) == 5 and np.allclose(ensemble.raw(x), held.raw, atol=1e-9)
    assert sum(calls) <= 5 * 300 * (1 + 4 / 2)  # all rows of the root, then at most half of those of each level

"""Forests against a plain grower, with and without tops, and the work they take."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardlens.models import candidates, explain, forest
from wardlens.models.forest import Rules


def made(spark, n, classes, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 3] = rng.integers(0, 2, n)
    y = x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(size=n)
    y = (y > 0.3).astype(float) if classes else y
    rows = [(f"P-{k}", float(t), 1.0 + t / 2 if classes else 1.0, Vectors.dense(r)) for k, (r, t) in enumerate(zip(x.tolist(), y.tolist()))]
    return spark.createDataFrame(rows, ["facility_id", "label", "w", "features"]).repartition(3)


def plain(x, y, w, times, tree, rules):
    """Leaf statistics of every row, grown node by node on raw values."""
    out = np.zeros(len(y))

    def score(rows):
        if not rules.classes:
            return (times[rows] * y[rows]).sum() ** 2 / times[rows].sum()
        parts = [(times[rows] * w[rows] * (y[rows] == k)).sum() for k in range(rules.classes)]
        return sum(p**2 for p in parts) / sum(parts)

    def down(rows, path):
        best = (0.0, None)
        may = forest.allowed(np.array([path]), tree, x.shape[1], rules)
        weight = (times[rows] * (w[rows] if rules.classes else 1)).sum()
        for f in range(x.shape[1]):
            if (may is not None and not may[0, f]) or path.bit_length() > rules.max_depth:
                continue
            for c in np.unique(x[:, f]):
                a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if min(times[a].sum(), times[b].sum()) < rules.min_leaf:
                    continue
                gain = round((score(a) + score(b) - score(rows)) / weight, 9)
                if gain > best[0]:
                    best = (gain, (a, b, f, c))
        if best[1] is None:
            return lambda r: rows
        a, b, f, c = best[1]
        left, right = down(a, 2 * path), down(b, 2 * path + 1)
        return lambda r: left(r) if x[r, f] <= c else right(r)

    leaf = down(np.flatnonzero(times), 1)
    for r in range(len(y)):
        rows = leaf(r)
        parts = times[rows] * (w[rows] if rules.classes else 1)
        out[r] = (parts * y[rows]).sum() / parts.sum()
    return out


@pytest.mark.parametrize("local_rows", [forest.LOCAL_ROWS, 40])
@pytest.mark.parametrize("classes, subset", [(0, 0), (0, 2), (2, 2)])
def test_equals_the_plain_grower(spark, monkeypatch, classes, subset, local_rows):
    """The same for any size at which rests are grown in a task."""
    monkeypatch.setattr(forest.fit_nodes, "__defaults__", (None, local_rows))
    rules = Rules(trees=3, max_depth=6, min_leaf=4, subset=subset, classes=classes)
    df = made(spark, 200, classes)
    stored, cuts, _ = forest._binned(df, "w")
    rows = stored.orderBy("id").toPandas()
    bins = np.stack([np.frombuffer(b, np.uint8) for b in rows["bins"]])
    raw = np.stack([np.array(cuts[f])[bins[:, f]] for f in range(4)], axis=1)
    y, w, ids = rows["label"].to_numpy(), rows["weight"].to_numpy(), rows["id"].to_numpy()
    want = np.mean([plain(raw, y, w, forest.drawn(ids, t, rules).astype(float), t, rules) for t in range(3)], axis=0)
    model = forest.Forest(rules, bool(classes), "w" if classes else None).fit(df)
    again = spark.createDataFrame([(k, Vectors.dense(r)) for k, r in enumerate(raw.tolist())], ["k", "features"])
    out = model.transform(again).orderBy("k").collect()
    got = [r.probability[1] if classes else r.prediction for r in out]
    assert np.allclose(got, want, atol=1e-9)
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9 and model.getNumTrees == 3


def test_rows_are_drawn_with_mean_one():
    rules = Rules()
    times = np.concatenate([forest.drawn(np.arange(20_000), t, rules) for t in range(5)])
    assert abs(times.mean() - 1) < 0.02 and abs((times == 0).mean() - np.exp(-1)) < 0.01
    assert (forest.drawn(np.arange(100), 0, rules) != forest.drawn(np.arange(100), 1, rules)).any()


def test_deep_trees_take_no_job_per_level(spark):
    df = made(spark, 1500, 2)
    sc = spark.sparkContext
    counts = []
    for depth in (2, 30):
        sc.setJobGroup(f"forest-{depth}", "")
        model = candidates.forest_classifier(candidates.Sizes(trees=4, tree_depth=depth)).fit(df)
        counts.append(len(sc.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(t.depth for t in model.trees) > 8 and counts[0] == counts[1]


@pytest.mark.parametrize("classes", [0, 2])
def test_predictions_in_parts_equal_spark_ml_after_a_store(spark, monkeypatch, tmp_path, classes):
    """Groups of trees meet blocks of rows in tasks of their own; the stored model gives the same."""
    for name, value in (("BLOCK", 16), ("PART_ROWS", 70), ("GROUPS", 2)):
        monkeypatch.setattr(forest, name, value)
    df = made(spark, 200, classes)
    fitted = forest.Forest(Rules(trees=5, max_depth=8, min_leaf=3), bool(classes)).fit(df)
    PipelineModel([fitted]).write().overwrite().save(str(tmp_path / "m"))
    (again,) = PipelineModel.load(str(tmp_path / "m")).stages
    value = vector_to_array("probability")[1] if classes else F.col("prediction")
    rows = df.unionAll(df.where("facility_id < 'P-12'"))
    want, *got = [
        sorted(tuple(r) for r in m.transform(rows).select("facility_id", F.round("prediction", 9), F.round(value, 9)).collect())
        for m in (fitted.spark_model(), fitted, again)
    ]
    assert len(want) > 200 and got == [want, want]
    assert np.allclose(fitted.featureImportances.toArray(), fitted.spark_model().featureImportances.toArray())


def test_permutations_are_scored_together(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(explain, "_output", lambda model, rows, task: calls.append(1) or rows.withColumn("output", F.col("a") + F.col("b")))
    rows = spark.createDataFrame([(f"P-{k}", k % 7, k % 2, float(k % 7 > 3)) for k in range(60)], ["facility_id", "a", "b", "label"])
    found = explain.permutation_importance(None, rows, "classification", columns=["a", "b"]).collect()
    assert len(calls) == 1 and found[0].feature == "a" and found[0].importance > 0.2


def test_labels_are_needed(spark):
    df = made(spark, 30, 2)
    for bad in (df.limit(0), df.selectExpr("IF(label = 1, null, label) AS label", "w", "features")):
        with pytest.raises(ValueError):
            forest.Forest(Rules(trees=2), True).fit(bad)


@pytest.mark.parametrize("classes, subset", [(0, 0), (2, 5)])
def test_levels_of_a_category_are_searched_in_one_pass(monkeypatch, classes, subset):
    """Sums are added up per column, not per level, and the trees stay those of levels searched one by one."""
    rng = np.random.default_rng(5)
    n = 3000
    levels, kinds, many = rng.integers(0, 12, n), rng.integers(0, 4, n), rng.integers(0, 40, n)
    bins = np.concatenate([levels == np.arange(11)[:, None], kinds == np.arange(4)[:, None], [kinds % 2 == 0, many, many > 50]]).astype(np.uint8)
    bins[15] += 1  # two bins, the lower of which is not 0
    label = (many > 20) + (levels % 3 == 0) + rng.normal(size=n)
    label = (label > 1).astype(float) if classes else label
    rules = Rules(classes=classes, subset=subset, max_depth=8)
    cuts = [np.arange(b.max() + 1.0) for b in bins]
    stats = forest._stats(rng.integers(1, 4, n), label, np.ones(n), rules)
    cells, calls = forest._cells, []
    monkeypatch.setattr(forest, "_cells", lambda *args: calls.append(1) or cells(*args))
    got = forest.grow(bins, stats, 0, 1, cuts, rules)
    few = len(calls)
    monkeypatch.setattr(forest, "SHARED", 1)
    want = forest.grow(bins, stats, 0, 1, cuts, rules)
    assert few <= 8 * 4 < len(calls) - few
    assert len(got["feature"]) > 40 and got["feature"].max() <= 16  # the last feature has one bin
    assert all(np.allclose(got[c], want[c], atol=1e-8) for c in got)


def test_nodes_of_whole_trees_are_written_once(spark, monkeypatch):
    names, kept = [], forest.materialize
    monkeypatch.setattr(forest, "materialize", lambda df, name: names.append(name) or kept(df, name))
    model = forest.Forest(Rules(trees=2, max_depth=4), False).fit(made(spark, 200, 0))
    assert names == ["forest-rows", "forest-binned"] and model.nodes == sum(t.numNodes for t in model.trees)

"""Leakage guards, preparation against numpy, folds and splits, linear models, reports, explanations."""

import math

import numpy as np
import pyarrow as pa
import pytest
from conftest import N_PROVIDERS
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import registry_models
from wardlens.models import candidates, columns, explain, metrics, preprocess, splits, train, triage, validate
from wardlens.sources.sinks import save_model

TINY = candidates.Sizes(trees=5, tree_depth=4, boost_rounds=2, long_rounds=2, long_depth=2, max_iter=200)


def test_no_leakage_column_is_a_predictor(features):
    assert not set(columns.select_x(features, "regression").columns) & set(columns.LEAKAGE)


def test_star_is_kept_for_classification_only(features):
    assert "patient_star_avg" in columns.select_x(features, "classification").columns
    assert "patient_star_avg" not in columns.select_x(features, "regression").columns


def test_unknown_task_is_an_error(features):
    with pytest.raises(ValueError):
        columns.select_x(features, "clustering")


@pytest.mark.parametrize("task, baseline", [("regression", "Baseline (mean)"), ("classification", "Baseline (majority)")])
def test_candidates(spark, task, baseline):
    models = candidates.candidate_models(task)
    assert next(iter(models)) == baseline and len(models) == 5
    assert all(isinstance(m.copy(), Estimator) for m in models.values())


@pytest.fixture(scope="module")
def holed(features):
    """Features with gaps and a rare level."""
    n = F.substring("facility_id", 3, 5).cast("int")
    return features.withColumns(
        {
            "timely_care_avg": F.when(n % 7 != 0, F.col("timely_care_avg")),
            "state": F.when(n < 5, "VT").when(n < 8, "WY").otherwise(F.col("state")),
            "hospital_type": F.when(n != 9, F.col("hospital_type")),
        }
    ).cache()


def test_preparation_equals_numpy(spark, holed):
    rows = columns.model_rows(holed, "classification")
    model = preprocess.Preprocessor(columns.CLF_NUMERIC, min_rows=10).fit(rows)
    names = preprocess.feature_names(model)
    got = model.transform(rows).orderBy("facility_id").select("*", vector_to_array("features").alias("v")).toPandas()
    matrix = np.array(got["v"].tolist())
    assert matrix.shape == (N_PROVIDERS, len(names))
    assert names[-5:] == list(columns.CLF_NUMERIC)
    for i, c in enumerate(columns.CLF_NUMERIC):
        x = got[c].astype(float).to_numpy()
        x = np.where(np.isnan(x), np.nanmedian(x), x)
        assert np.allclose(matrix[:, len(names) - 5 + i], (x - x.mean()) / x.std())
    assert "state_other" in names and "state_VT" not in names and "hospital_type_other" in names
    rare = matrix[:, names.index("state_other")]
    assert list(np.where(rare == 1)[0]) == list(range(8))
    assert (matrix[:, : len(names) - 5].sum(axis=1) == 3).all()


def test_unseen_level_is_all_zeros_and_unseen_numbers_work(spark, holed):
    rows = columns.model_rows(holed, "regression")
    model = preprocess.Preprocessor(columns.REG_NUMERIC, min_rows=10).fit(rows)
    names = preprocess.feature_names(model)
    new = rows.limit(1).withColumns({"state": F.lit("GU"), "timely_care_avg": F.lit(None).cast("double")})
    v = model.transform(new).select(vector_to_array("features")).first()[0]
    assert sum(x for x, n in zip(v, names) if n.startswith("state_")) == 0
    assert all(math.isfinite(x) for x in v)


def test_number_column_without_values_is_left_out(holed):
    rows = columns.model_rows(holed.withColumn("timely_care_avg", F.lit(None).cast("double")), "regression")
    model = preprocess.Preprocessor(columns.REG_NUMERIC).fit(rows)
    assert "timely_care_avg" not in preprocess.feature_names(model)
    assert model.transform(rows).count() == N_PROVIDERS


def test_hold_out_is_exact_and_repeatable(spark, features):
    rows = columns.model_rows(features, "classification")
    a_train, a_test = splits.hold_out(rows, stratify=True)
    b_train, b_test = splits.hold_out(rows.repartition(13), stratify=True)
    ids = {r.facility_id for r in a_test.collect()}
    assert len(ids) == N_PROVIDERS // 5 and ids == {r.facility_id for r in b_test.collect()}
    assert a_train.count() == N_PROVIDERS - N_PROVIDERS // 5 and not ids & {r.facility_id for r in a_train.collect()}
    assert splits.hold_out(rows.limit(101))[1].count() == 21


@pytest.mark.parametrize("counts, total, want", [({0.0: 3015, 1.0: 2417}, 1087, (603, 484)), ({0.0: 5, 1.0: 5}, 3, (2, 1))])
def test_quotas(counts, total, want):
    assert tuple(splits.quotas(counts, total).values()) == want


def test_stratified_fold_sizes_follow_the_laid_out_classes():
    sizes = splits.stratified_fold_sizes([1.0, 0.0], {1.0: 7, 0.0: 6}, 5)
    assert sizes == {1.0: [2, 2, 1, 1, 1], 0.0: [1, 1, 2, 1, 1]}


@pytest.mark.parametrize("stratify", [False, True])
def test_folds_are_contiguous_blocks(features, stratify):
    rows = columns.model_rows(features, "classification")
    folded = splits.contiguous_folds(rows, 5, stratify).orderBy("facility_id").collect()
    groups = {r.label for r in folded} if stratify else {None}
    for g in groups:
        folds = [r.fold for r in folded if g is None or r.label == g]
        assert folds == sorted(folds) and set(folds) == set(range(5))
    assert len(folded) == N_PROVIDERS


def _prepared(features, task):
    rows = columns.model_rows(features, task)
    model = preprocess.Preprocessor(columns.task_of(task).numeric).fit(rows)
    return model.transform(rows).select("facility_id", "label", "features", vector_to_array("features").alias("v")).cache()


def test_ridge_equals_the_closed_form(features):
    df = _prepared(features, "regression")
    fitted = candidates.candidate_models("regression")["Ridge"].fit(df)
    pdf = df.toPandas()
    x, y = np.array(pdf["v"].tolist()), pdf["label"].to_numpy()
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    assert np.allclose(fitted.coefficients.toArray(), w, atol=1e-4)


def test_balanced_logistic_equals_newton(features):
    df = _prepared(features, "classification")
    fitted = candidates.candidate_models("classification", TINY)["LogisticRegression"].fit(df)
    pdf = df.toPandas()
    x, y = np.array(pdf["v"].tolist()), pdf["label"].to_numpy()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        grad = a.T @ (weight * (p - y)) + penalty @ w
        w -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty, grad)
    assert np.allclose(fitted.coefficients.toArray(), w[:-1], atol=1e-2)


def test_training_scoring_and_storing(spark, features, tmp_path):
    clf = train.train_underperformer(features, TINY)
    reg = train.train_satisfaction(features, TINY)
    doc = train.evaluate(reg, clf).first()
    assert (doc.classification.n_train, doc.classification.n_test, doc.regression.n_test) == (N_PROVIDERS - N_PROVIDERS // 5, N_PROVIDERS // 5, N_PROVIDERS // 5)
    assert set(doc.classification.report) == {"0", "1", "macro avg", "weighted avg"}
    assert doc.classification.report["macro avg"].support == N_PROVIDERS // 5
    scored = train.score(features, clf.model)
    rows = scored.collect()
    assert len(rows) == N_PROVIDERS and all(0 <= r.predicted_risk <= 1 for r in rows)
    values = sorted((r.predicted_risk for r in rows), reverse=True)
    assert all(r.risk_rank == values.index(r.predicted_risk) + 1 for r in rows)
    save_model(clf.model, str(tmp_path / "m"))
    again = train.score(features, PipelineModel.load(str(tmp_path / "m")))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert triage.triage(scored, "All", 5).count() == 5
    assert triage.triage(scored, "All", 51).count() == 51 and triage.triage(scored, "All", 1).count() == 1
    names = preprocess.feature_names(clf.model.stages[0])
    assert len(names) == clf.model.stages[1].numFeatures
    assert explain.split_importance(clf.model).count() == len(names)
    assert explain.split_importance(clf.model, top=3).count() == 3


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.3)], "label int, score double")
    rows = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].f1_score, rows["1"].support) == (0.0, 0.0, 0.0, 1)
    assert rows["0"].precision == 0.666667 and rows["accuracy"].f1_score == 0.666667


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, score double")
    assert metrics.roc_auc(df).first().roc_auc == 0.625
    assert metrics.roc_auc(df.filter("label = 1")).first().roc_auc is None


def test_r2_of_a_constant_label(spark):
    df = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "label double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert (row.r2, row.mae) == (0.0, 0.5)


def test_leaderboard_of_the_cheap_models(features):
    board = validate.compare_models(features, TINY, models=["Baseline (mean)", "Ridge", "Baseline (majority)"]).collect()
    assert [r.task for r in board] == ["classification", "regression", "regression"]
    assert (board[0].cv_mean, board[0].cv_std) == (0.5, 0.0)
    pdf = columns.model_rows(features, "regression").orderBy("facility_id").toPandas()
    y, scores = pdf["label"].to_numpy(), []
    for k in np.array_split(np.arange(len(y)), 5):
        rest = np.delete(y, k)
        scores.append(1 - ((y[k] - rest.mean()) ** 2).sum() / ((y[k] - y[k].mean()) ** 2).sum())
    mean = next(r for r in board if r.model == "Baseline (mean)")
    assert (mean.cv_mean, mean.cv_std) == (round(float(np.mean(scores)), 4), round(float(np.std(scores)), 4))


def test_folds_grown_together_score_like_fits_fold_by_fold(features):
    name = "GradientBoosting"
    together = validate.fold_scores(features, "classification", TINY, models=[name])[name]
    folded = splits.contiguous_folds(columns.model_rows(features, "classification"), stratify=True)
    task, alone = columns.TASKS["classification"], []
    for fold in range(2):
        prepared = preprocess.Preprocessor(task.numeric).fit(folded.filter(F.col("fold") != fold))
        fit = candidates.candidate_models("classification", TINY)[name].fit(prepared.transform(folded.filter(F.col("fold") != fold)))
        held = prepared.transform(folded.filter(F.col("fold") == fold))
        alone.append(validate._evaluator(task).evaluate(fit.transform(held)))
    assert len(together) == 5 and together[:2] == pytest.approx(alone, abs=1e-9)


def test_shapley_contributions_add_up(spark, features):
    fitted = train.train_satisfaction(features, TINY)
    rows = columns.model_rows(features, "regression")
    per_row = explain.shapley_rows(fitted.model, rows, "regression", n=10, orders=3)
    assert per_row.count() == 10 * 7
    total = per_row.groupBy("facility_id").agg(F.sum("contribution").alias("total"))
    outputs = fitted.model.transform(explain.hash_sample(rows, 10, 42)).select("facility_id", "prediction")
    low, high = outputs.agg(F.min("prediction"), F.max("prediction")).first()
    for r in total.join(outputs, "facility_id").collect():
        start = r.prediction - r.total
        assert low - 1e-9 <= start <= high + 1e-9


def test_shuffled_column_is_a_permutation(features):
    rows = columns.model_rows(features, "regression")
    moved = explain.shuffled_column(rows, "timely_care_avg", 1)
    assert sorted(moved.columns) == sorted(rows.columns)
    a = {r.facility_id: r.timely_care_avg for r in rows.collect()}
    b = {r.facility_id: r.timely_care_avg for r in moved.collect()}
    assert sorted(a.values()) == sorted(b.values()) and a != b and a.keys() == b.keys()


def test_unused_column_has_no_permutation_importance(spark, features):
    flat = features.withColumn("completed_surveys", F.lit(7.0))
    fitted = train.train_underperformer(flat, TINY)
    rows = columns.model_rows(flat, "classification")
    got = explain.permutation_importance(fitted.model, rows, "classification", columns=["completed_surveys"]).first()
    assert got.importance == 0.0


def test_metrics_document_fits_both_models_on_one_stored_table(spark, features, monkeypatch):
    stored = []
    monkeypatch.setattr(registry_models, "SIZES", TINY)
    monkeypatch.setattr(registry_models, "stored_features", lambda spark, sf_dir: stored.append(1) or features)
    got = registry_models.document(spark, "").first()
    assert len(stored) == 1
    assert got == train.evaluate(train.train_satisfaction(features, TINY), train.train_underperformer(features, TINY)).first()


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_shapley_contributions_equal_scored_mixes(spark, features, task, monkeypatch):
    """Against every mixed row written out and scored by itself; levels never seen and missing numbers occur."""
    fit = train.train_underperformer if task == "classification" else train.train_satisfaction
    model, seed, orders = fit(features, TINY).model, 42, 2
    rows = columns.model_rows(features, task).orderBy("facility_id").limit(14).withColumns(
        {"state": F.when(F.col("facility_id") < "P-00003", F.lit("never seen")).otherwise(F.col("state")),
         "completed_surveys": F.when(F.col("facility_id") > "P-00011", F.lit(None)).otherwise(F.col("completed_surveys"))}
    )
    names = [*columns.CATEGORICAL, *columns.task_of(task).numeric]
    own = rows.orderBy("facility_id").collect()
    keys = [F.xxhash64("facility_id", "draw", F.lit(c), F.lit(seed)).alias(f"at_{c}") for c in names]
    draws = rows.select("facility_id", F.explode(F.sequence(F.lit(1), F.lit(orders))).alias("draw")).select(
        "facility_id", "draw", F.pmod(F.xxhash64("facility_id", "draw", F.lit(seed)), F.lit(len(own))).alias("start"), *keys
    )
    mixes, walks, by_id = [], [], {r.facility_id: r for r in own}
    for d in draws.collect():
        order = sorted(names, key=lambda c: (d[f"at_{c}"], c))
        walks.append((d.facility_id, order))
        for step in range(len(names) + 1):
            mixes.append((f"{len(walks) - 1}:{step}", *[by_id[d.facility_id][c] if c in order[:step] else own[d.start][c] for c in names]))
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in names)
    scored = model.transform(spark.createDataFrame(mixes, f"facility_id string, {kinds}"))
    value = vector_to_array("probability")[1] if task == "classification" else F.col("prediction")
    output = {r.facility_id: r.output for r in scored.select("facility_id", value.alias("output")).collect()}
    want = {}
    for k, (row, order) in enumerate(walks):
        for step, c in enumerate(order):
            want[row, c] = want.get((row, c), 0.0) + (output[f"{k}:{step + 1}"] - output[f"{k}:{step}"]) / orders
    monkeypatch.setattr(explain, "WALKS", 3)
    monkeypatch.setattr(type(model.stages[1]), "_transform", None)  # no mixed row is written
    got = {(r.facility_id, r.feature): r.contribution for r in explain.shapley_rows(model, rows, task, orders=orders, seed=seed).collect()}
    assert got.keys() == want.keys() and any(abs(v) > 1e-3 for v in got.values())
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_walks_are_packed_by_runs_of_row_numbers(monkeypatch):
    monkeypatch.setattr(explain, "WALKS", 2)
    code = lambda *x: np.array(x, np.uint16).tobytes()
    numbers = [0, 1, 2, 8, 9]
    batch = pa.RecordBatch.from_pydict(
        {"_row": numbers, "own": [code(k, 1) for k in numbers], "starts": [[code(k, 2)] for k in numbers], "orders": [[1, 0]] * 5}
    )
    blocks = [(r["first"], r["bins"]) for b in explain.pack_walks([batch], 1, 2) for r in b.to_pylist()]
    assert [(first, int.from_bytes(block[:4], "little")) for first, block in blocks] == [(0, 2), (2, 1), (8, 2)]
    plain = [pa.decompress(block[4:], 20 if first != 2 else 10, "zstd", asbytes=True) for first, block in blocks]
    assert plain[2] == code(8, 1) + code(9, 1) + code(8, 2) + code(9, 2) + bytes([1, 0, 1, 0])


def test_registered_leaderboard_fits_every_candidate_at_full_size(spark, features, monkeypatch):
    asked = []
    monkeypatch.setattr(registry_models, "stored_features", lambda spark, sf_dir: features)
    monkeypatch.setattr(validate, "compare_models", lambda table, sizes, **more: asked.append((sizes, more)) or table)
    registry_models.models()["m_cv"](spark, "")
    assert asked == [(candidates.Sizes(), {})]
    assert (asked[0][0].trees, asked[0][0].tree_depth, asked[0][0].boost_rounds, asked[0][0].long_rounds) == (300, 30, 100, 400)

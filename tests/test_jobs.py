"""The command steps end to end: raw files to features, archives to snapshots, panel, trends, models."""

import pytest
from test_models import TINY
from test_sources import release_files, release_zip, zipped

from wardlens import jobs
from wardlens.sources import sinks


def test_features_of_one_release(spark, tmp_path):
    names = {"general": "Hospital_General_Information.csv", "survey": "HCAHPS-Hospital.csv",
             "timely": "Timely_and_Effective_Care-Hospital.csv"}
    (tmp_path / "raw").mkdir()
    for table, text in release_files("A").items():
        (tmp_path / "raw" / names[table]).write_text(text)
    shown = jobs.features(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert {tuple(r) for r in shown["balance"].collect()} == {(1, 1.0)}
    assert dict(map(tuple, shown["coverage"].collect()))["_readm_worse"] == 0.0


def test_archives_to_trends(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    annual = zipped({f"hospitals_{p}.zip": release_zip(name="A", rating=r) for p, r in (("2021-01-27", "4"), ("2021-04-28", "3"))})
    (tmp_path / "raw" / "hospitals_annual_2021.zip").write_bytes(annual)
    step = {k: str(tmp_path / k) for k in ("raw", "snapshots", "panel", "trends")}
    assert jobs.build_snapshots(spark, step["raw"], step["snapshots"])["releases"].count() == 2
    summary = jobs.panel(spark, step["snapshots"], step["panel"])["summary"].first()
    assert tuple(summary) == (2, 1, 2, 0)
    assert tuple(jobs.trends(spark, step["panel"], step["trends"])["flagged"].first()) == (1, 0)
    moved = spark.read.parquet(step["panel"]).filter("period = '2021-04-28'").first()
    assert moved.overall_rating_delta == -1.0
    with pytest.raises(FileNotFoundError):
        jobs.build_snapshots(spark, step["trends"], step["snapshots"])


def test_training_outputs(spark, features, tmp_path):
    sinks.write_table(features, str(tmp_path / "features"))
    out = str(tmp_path / "models")
    metrics = jobs.train_models(spark, str(tmp_path / "features"), out, TINY)["metrics"].first()
    assert metrics.classification.n_test == features.count() // 5
    assert spark.read.parquet(f"{out}/scored").count() == features.count()
    drivers = spark.read.option("header", True).csv(f"{out}/regression_drivers")
    assert drivers.count() == 7

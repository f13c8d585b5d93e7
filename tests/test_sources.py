"""Readers on files made by the tests: encodings, quoting, renamed headings, snapshots, archives."""

import io
import json
import random
import zipfile

import pandas as pd
import pytest
from conftest import feature_rows

from wardlens.models.triage import model_card, read_metrics
from wardlens.sources import archives, delimited, schemas, sinks, snapshots
from wardlens.sources.scratch import scratch_root

GENERAL = "Facility ID,Facility Name,State,{county},Hospital Type,Hospital Ownership,Emergency Services,Hospital overall rating{extra}\n"
SURVEY = "Facility ID,Patient Survey Star Rating,Survey Response Rate Percent,Number of Completed Surveys\n"
TIMELY = "Facility ID,Score\n"


def release_files(name, rating="4", county="County/Parish", counts=True):
    extra = ",Count of MORT Measures Worse,Count of Safety Measures Worse,Count of READM Measures Worse" if counts else ""
    general = GENERAL.format(county=county, extra=extra)
    general += f'010001,"{name}",AL,HOUSTON,Acute Care Hospitals,Proprietary,Yes,{rating}' + (",1,0,Not Available" if counts else "") + "\n"
    return {
        "general": general,
        "survey": SURVEY + "010001,4,30,100\n010001,Not Applicable,31,90\n",
        "timely": TIMELY + "010001,90\n010001,120\n010001,Not Available\n",
    }


def test_positional_load(spark, tmp_path):
    (tmp_path / "t.csv").write_text('A,B,C\n"x, ""y""",,010\n"",Not Available,"line"\n')
    schema = schemas.text_schema(("one", "two", "three"))
    got = [tuple(r) for r in delimited.load_table(spark, str(tmp_path / "t.csv"), schema).collect()]
    assert got == [('x, "y"', "", "010"), ("", "Not Available", "line")]


def test_positional_load_with_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('A,B\n"a\nb",c\n')
    got = delimited.load_table(spark, str(tmp_path / "t.csv"), schemas.text_schema(("x", "y")), multi_line=True).collect()
    assert [tuple(r) for r in got] == [("a\nb", "c")]


def test_release_csv_of_both_encodings_and_a_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ Facility ID ,Facility Name\n001,Señora\n002,Ñandú\n".encode())
    (tmp_path / "b.csv").write_bytes("Facility ID,Facility Name\n003,Señora\n".encode("latin-1"))
    df = delimited.read_release_csv(spark, str(tmp_path))
    assert df.columns == ["Facility ID", "Facility Name", "row_seq"]
    assert [tuple(r)[:2] for r in df.orderBy("row_seq").collect()] == [("001", "Señora"), ("002", "Ñandú"), ("003", "Señora")]


def test_snapshot_folders(spark, tmp_path):
    old, new = tmp_path / "2021-01-27", tmp_path / "2021-04-28"
    old.mkdir(), new.mkdir()
    for table, text in release_files("OLD NAME", county="County Name", counts=False).items():
        (old / {"general": "Hospital_General_Information.csv", "survey": "HCAHPS-Hospital.csv",
                "timely": "Timely_and_Effective_Care-Hospital.csv"}[table]).write_text(text)
    heads = [f.name for f in schemas.FEATURES]
    lines = [",".join(map(str, r)) for r in feature_rows(3)]
    (new / "hospital_features.csv").write_text("\n".join([",".join(heads), *lines]) + "\n")
    panel = snapshots.load_snapshots(spark, str(tmp_path))
    rows = {(r.period, r.facility_id): r for r in panel.collect()}
    assert set(rows) == {("2021-01-27", "010001"), *[("2021-04-28", f"P-0000{i}") for i in range(3)]}
    first = rows["2021-01-27", "010001"]
    assert (first.county, first.composite_risk_score, first.timely_care_avg, first.patient_star_avg) == ("HOUSTON", None, 90.0, 4.0)
    (tmp_path / "2022-01-01").mkdir()
    (tmp_path / "2022-01-01" / "other.csv").write_text("a\n1\n")
    with pytest.raises(FileNotFoundError):
        snapshots.load_snapshots(spark, str(tmp_path))


def test_plan_does_not_grow_with_releases(spark, tmp_path):
    """Releases of both encodings and two headings are read by layout: labels, headings and duplicates stay apart."""
    names = {"general": "Hospital_General_Information.csv", "survey": "HCAHPS-Hospital.csv", "timely": "Timely_and_Effective_Care-Hospital.csv"}

    def write(label, encoding="utf-8", **kw):
        folder = tmp_path / label
        folder.mkdir()
        for table, text in release_files(**kw).items():
            if table == "general":  # a part of a folder named like the file
                (folder / names[table]).mkdir()
                (folder / names[table] / "part-0.csv").write_bytes(text.encode(encoding))
            else:
                (folder / names[table]).write_text(text)

    def scans():
        plan = snapshots.load_snapshots(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation ")

    write("period=2020-01-01", name="Señora", encoding="latin-1")
    write("2020 + 02", name="Ñandú", county="County Name", counts=False)
    few = scans()
    for k in range(12):
        write(f"2021-{k:02d}", name=f"Ñ {k}", county="County Name" if k % 2 else "County/Parish", counts=k % 2 == 0, rating=str(1 + k % 5))
    assert scans() <= few + 2
    rows = {r.period: r for r in snapshots.load_snapshots(spark, str(tmp_path)).collect()}
    assert len(rows) == 14
    assert rows["2020-01-01"].facility_name == "Señora" and rows["2020 + 02"].facility_name == "Ñandú"
    for k in range(12):
        r = rows[f"2021-{k:02d}"]
        assert (r.facility_name, r.county, r.overall_rating, r.composite_risk_score) == (f"Ñ {k}", "HOUSTON", 1.0 + k % 5, None if k % 2 else 1.0)
    with pytest.raises(FileNotFoundError):
        snapshots.load_release(spark, str(tmp_path))
    assert snapshots.load_release(spark, str(tmp_path / "2021-03")).collect()[0].facility_name == "Ñ 3"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def release_zip(encoding="utf-8", **kw):
    names = {"general": "x/HOSPITAL_General_Information.csv", "survey": "HCAHPS-Hospital.csv", "timely": "y/z/Timely_and_Effective_Care-Hospital.csv"}
    return zipped({names[t]: text.encode(encoding) for t, text in release_files(**kw).items()})


def archive_folder(folder):
    """Two annual archives: releases of both encodings, a repeated label, an unusable release, other members."""
    short = zipped({"HCAHPS-Hospital.csv": SURVEY})
    first = zipped({"hospitals_2021-01-27.zip": release_zip(name="Señora", encoding="latin-1", counts=False, county="County Name"),
                    "hospitals_2021-02-01.zip": short, "notes.txt": b"no release"})
    second = zipped({"spring.zip": release_zip(name="Ñandú", rating="2"), "a_2021-01-27.ZIP": release_zip(name="later wins"),
                     "q/2022-04-27.zip": release_zip(name="third"), "q/2022-07-27.zip": release_zip(name="fourth")})
    (folder / "hospitals_annual_2021.zip").write_bytes(first)
    (folder / "hospitals_annual_2022.zip").write_bytes(second)
    (folder / "other.zip").write_bytes(second)


@pytest.mark.parametrize("chunk_bytes", [archives.CHUNK_BYTES, 300])
def test_archives(spark, tmp_path, chunk_bytes):
    """With chunks of some hundred bytes members and directories lie in many of them, as those of large archives do."""
    archive_folder(tmp_path)
    chunks = archives.archive_chunks(spark, str(tmp_path), chunk_bytes=chunk_bytes)
    assert {r.archive.split("/")[-1] for r in chunks.collect()} == {"hospitals_annual_2021.zip", "hospitals_annual_2022.zip"}
    rows = {r.period: r for r in archives.features_of_archives(chunks).collect()}
    assert set(rows) == {"2021-01-27", "spring", "2022-04-27", "2022-07-27"}
    assert rows["spring"].facility_name == "Ñandú" and rows["spring"].is_underperformer == 1
    assert rows["2021-01-27"].facility_name == "later wins"
    assert (rows["spring"].patient_star_avg, rows["spring"].survey_response_rate, rows["spring"].timely_care_avg) == (4.0, 31.0, 90.0)
    alone = {r.period: r for r in archives.features_of_archives(chunks.filter("archive like '%2021.zip'")).collect()}
    assert alone["2021-01-27"].facility_name == "Señora" and alone["2021-01-27"].composite_risk_score is None


def test_archive_split_over_tasks(spark, tmp_path):
    """An archive is read by many tasks, byte for byte; directories list what the library lists."""
    rng = random.Random(4)
    members = {f"release_{k}.zip": zipped({"x": rng.randbytes(rng.randint(0, 90_000))}) for k in range(30)}
    body = zipped(members)
    (tmp_path / "hospitals_annual_1.zip").write_bytes(body + b"\n")
    with zipfile.ZipFile(tmp_path / "hospitals_annual_2.zip", "w") as z:
        for name, content in members.items():
            with z.open(name, "w", force_zip64=True) as out:
                out.write(content)
        z.comment = b"a comment of the archive"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        chunks = archives.archive_chunks(spark, str(tmp_path), chunk_bytes=20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    parts = sorted((r.offset, bytes(r.data)) for r in chunks.where("archive like '%1.zip'").collect())
    assert len(parts) > 30 and b"".join(p for _, p in parts) == body + b"\n"
    assert [o for o, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
    assert sorted(r.member for r in archives.archive_members(chunks).collect()) == sorted([*members, *members])
    got = {}
    for r in archives.releases(chunks, 30_000).orderBy("archive", "member", "chunk").collect():
        got[r.archive, r.member] = got.get((r.archive, r.member), b"") + bytes(r.data)
    assert len(got) == 60 and all(content == members[m] for (_, m), content in got.items())


def test_one_release_per_task_and_one_scan_per_table(spark, tmp_path):
    archive_folder(tmp_path)
    chunks = archives.archive_chunks(spark, str(tmp_path))
    found = archives.releases(chunks)
    chosen = archives.choose(found).collect()
    assert sorted(r.task for r in chosen) == [0, 1, 2, 3]
    rows = archives.unpack_archives(chunks)
    survey = archives.release_table(rows, "survey")
    plan = survey._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(table_name" in plan
    assert {f.split("table_name=")[1].split("/")[0] for f in survey.inputFiles()} == {"survey"} or survey.count() == 8


def test_no_archives(spark, tmp_path):
    (tmp_path / "other.zip").write_bytes(b"")
    with pytest.raises(FileNotFoundError):
        archives.build_snapshots(spark, str(tmp_path), str(tmp_path / "out"))


def test_metrics_document_round_trip(spark, tmp_path):
    doc = {
        "regression": {"target": "patient_star_avg", "n_train": 40, "n_test": 10, "r2": 0.25, "mae_stars": 0.625},
        "classification": {"target": "is_underperformer", "n_train": 44, "n_test": 11, "roc_auc": 0.75, "accuracy": 0.6,
                           "report": {"1": {"precision": 0.5, "recall": 0.3751, "f1_score": 0.4, "support": 16}}},
    }
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    metrics = read_metrics(spark, str(tmp_path / "m.json"))
    card = {r.task: (r.score, r.detail, r.n_test) for r in model_card(metrics).collect()}
    assert card == {"regression": (0.25, 0.625, 10), "classification": (0.75, 0.38, 11)}
    sinks.write_metrics(metrics, str(tmp_path / "out"))
    assert read_metrics(spark, str(tmp_path / "out")).collect() == metrics.collect()


def test_partitioned_sink_prunes_releases(spark, features, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "panel")
    both = features.withColumn("period", F.lit("2021-01-27")).unionByName(features.withColumn("period", F.lit("2021-04-28")))
    sinks.write_table(both, path, ["period"])
    one = snapshots.load_snapshot_table(spark, path).filter("period = '2021-04-28'")
    assert one.count() == features.count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_release_files_are_read_as_pandas_reads_them(monkeypatch):
    """Even files by Arrow, from the first record with fewer fields on by pandas; in pieces, with the same rows."""
    monkeypatch.setattr(archives, "READ_BYTES", 256)
    general = {f: h[0] for f, h in schemas.RELEASE_FIELDS["general"].items()}
    heads = [f" {h} " for h in general.values()] + ["More"]
    row = lambda k, text: ",".join([str(k), f'"{text} ""{k}"",\n{k}"', *["" if k % 3 else "NA"] * (len(heads) - 2)])
    even = "\ufeff" + ",".join(heads) + "\n\n" + "".join(row(k, "Café") + "\r\n" for k in range(40))
    files = {"even": even.encode(), "latin": even[1:].encode("latin-1"), "uneven": (even + "7,short\n   \n" + row(8, "last")).encode(), "none": ",".join(heads).encode()}
    for name, content in files.items():
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for file in schemas.RELEASE_FILES.values():
                z.writestr(file, content)
        with zipfile.ZipFile(packed) as z:
            pieces = [p for p in archives._release_rows(z) if p[0] == "general"]
            encoding = "latin-1" if name == "latin" else "utf-8-sig"
            want = pd.read_csv(io.BytesIO(content), dtype=str, keep_default_na=False, encoding=encoding).rename(columns=str.strip)
        assert [k for _, places, _ in pieces for k in places.to_pylist()] == list(range(len(want)))
        assert name == "none" or len(pieces) > 1
        for k, field in enumerate(archives.FIELDS):
            got = [v for _, _, columns in pieces for v in columns[k].to_pylist()]
            mine = want[general[field]] if field in general else [None] * len(want)
            assert got == [None if pd.isna(v) else v for v in mine], (name, field)

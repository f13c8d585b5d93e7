"""Registered readers and writers: the derived tables are written out in a release layout and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.provider_tables import PROVIDER_SQL, SOURCES, provider
from checks.registry_jobs import feature_table, release_panel, scored_hospitals
from checks.registry_models import document, leaderboard
from wardlens.models.triage import read_metrics
from wardlens.plans import ingest, panel, trends
from wardlens.sources import archives, delimited, release_store, schemas, sinks, snapshots
from wardlens.sources.scratch import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

# The published headings of the fields the feature pipeline reads.
HEADINGS = {t: {field: names[0] for field, names in fields.items()} for t, fields in schemas.RELEASE_FIELDS.items()}
ACCENT = " é"
ROWS_PER_RELEASE = 20_000
RELEASES_PER_ARCHIVE = 3


def _csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    df.write.options(header=True, quote='"', escape='"', encoding=encoding, emptyValue="").csv(path)
    return path


def _with_headings(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(field).alias(heading) for field, heading in HEADINGS[table].items()])


def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 38 columns under other headings: only the position counts."""
    wide = schemas.conform(provider(spark, sf_dir, "facility"), schemas.GENERAL)
    path = _csv(wide.toDF(*[f"Heading {i}" for i in range(len(wide.columns))]), scratch_path(spark, "positional"))
    return delimited.load_table(spark, path, schemas.GENERAL)


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder with UTF-8 files and one with ISO-8859-1 files, headings padded, accents in names."""
    h = provider(spark, sf_dir, "facility")
    accented = h.withColumn("facility_name", F.concat("facility_name", F.lit(ACCENT)))
    root = scratch_path(spark, "text")
    for encoding, rest in (("UTF-8", 0), ("ISO-8859-1", 1)):
        part = _with_headings(accented.filter(F.col("row_seq") % 2 == rest), "general")
        _csv(part.toDF(*[f" {c} " for c in part.columns]), f"{root}/{encoding}", encoding)
    read = delimited.read_release_csv(spark, f"{root}/*")
    return read.select(*[F.col(f"`{heading}`").alias(field) for field, heading in HEADINGS["general"].items()])


def _release(pdf: pd.DataFrame) -> pd.DataFrame:
    """One release zip; odd releases hold ISO-8859-1 files."""
    shard = int(pdf["shard"].iloc[0])
    encoding = "utf-8" if shard % 2 == 0 else "latin-1"
    release = io.BytesIO()
    with zipfile.ZipFile(release, "w", zipfile.ZIP_DEFLATED) as z:
        for table, file in schemas.RELEASE_FILES.items():
            lines = [",".join(HEADINGS[table].values()), *pdf.loc[pdf["table_name"] == table, "line"]]
            z.writestr(f"data/{file.upper()}", ("\n".join(lines) + "\n").encode(encoding))
    return pd.DataFrame({"shard": [shard], "content": [release.getvalue()]})


def _annual(pdf: pd.DataFrame) -> pd.DataFrame:
    """One annual archive with its releases, an empty older one for each label, an unusable one and a note."""
    annual, empty, short = io.BytesIO(), io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        for table, file in schemas.RELEASE_FILES.items():
            z.writestr(file, ",".join(HEADINGS[table].values()) + "\n")
    with zipfile.ZipFile(short, "w") as z:
        z.writestr("other.csv", "a,b\n1,2\n")
    with zipfile.ZipFile(annual, "w") as z:
        for shard, content in zip(pdf["shard"], pdf["content"]):
            z.writestr(f"older/r{shard}.zip", empty.getvalue())
            z.writestr(f"releases/r{shard}.zip", content, zipfile.ZIP_DEFLATED if shard % 3 else zipfile.ZIP_STORED)
        z.writestr("releases/x-unusable.zip", short.getvalue())
        z.writestr("releases/readme.txt", "not a release")
    return pd.DataFrame({"content": [annual.getvalue()]})


def _as_text(batches):
    """Bytes as text without a change, which the text writer stores as they are."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()).view(pa.string())], ["value"])


def annual_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of archives made from whole tables, RELEASES_PER_ARCHIVE releases of about ROWS_PER_RELEASE rows in each.

    Rows are dealt to releases by order key, so no hospital's rows pile up in one.
    """
    sizes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    shards = -(-sizes // ROWS_PER_RELEASE)
    h = provider(spark, sf_dir, "facility").withColumn("facility_name", F.concat("facility_name", F.lit(ACCENT)))
    base = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "lineitem", "customer", "nation")}
    frames = {
        "general": (h, "row_seq"),
        "survey": (_keyed(spark, base, "survey", "o_orderkey"), "deal"),
        "timely": (_keyed(spark, base, "timely", "l_orderkey"), "deal"),
    }
    lines = [
        df.select(
            (F.col(deal) % shards).alias("shard"),
            F.lit(table).alias("table_name"),
            F.to_csv(F.struct(*HEADINGS[table]), {"quote": '"', "escape": '"', "emptyValue": ""}).alias("line"),
        )
        for table, (df, deal) in frames.items()
    ]
    rows = lines[0].unionByName(lines[1]).unionByName(lines[2])
    releases = rows.groupBy("shard").applyInPandas(_release, "shard long, content binary")
    year = F.floor(F.col("shard") / RELEASES_PER_ARCHIVE)
    return releases.groupBy(year.alias("year")).applyInPandas(_annual, "content binary")


def _keyed(spark: SparkSession, base: dict[str, DataFrame], name: str, key: str) -> DataFrame:
    """A derived table with the order key it was made from."""
    sql = PROVIDER_SQL[name].replace(" SELECT ", f" SELECT {key} AS deal, ", 1)
    return spark.sql(sql, **{t: base[t] for t in SOURCES[name]})


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written as files (a line feed follows each, which readers of zips ignore), read and unpacked."""
    folder = scratch_path(spark, "annual")
    files = annual_archives(spark, sf_dir).mapInArrow(_as_text, "value string")
    files.write.option("maxRecordsPerFile", 1).text(folder)
    return archives.features_of_archives(archives.archive_chunks(spark, folder, "part-*"))


def clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long care table parsed once and stored with typed companions, one folder per release."""
    path = scratch_path(spark, "clean")
    ingest.write_clean(provider(spark, sf_dir, "timely"), "timely", path)
    return ingest.read_clean(spark, path).select(
        "facility_id", "period", "score", F.col("score__double").alias("points"), F.col("measure_id__key").alias("measure")
    )


def snapshot_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per release: ready feature tables for the past ones, the three published files for the
    current one, all as CSV; loaded in one plan."""
    root = scratch_path(spark, "snapshots")
    past = materialize(release_panel(provider(spark, sf_dir, "snapshot")), "panel")
    for (period,) in past.select("period").distinct().collect():  # one row per release
        _csv(past.where(F.col("period") == period).drop("period"), f"{root}/{period}/{schemas.PREBUILT_FILE}")
    for source, table in (("facility", "general"), ("survey", "survey"), ("timely", "timely")):
        _csv(_with_headings(provider(spark, sf_dir, source), table), f"{root}/current/{schemas.RELEASE_FILES[table]}")
    return snapshots.load_snapshots(spark, root)


def derived_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "trends")
    warned = trends.early_warning(release_panel(provider(spark, sf_dir, "snapshot")))
    sinks.write_table(warned, path, fmt="csv")
    return spark.read.schema(warned.schema).option("header", True).csv(path)


def _stored(make: Callable[[SparkSession, str], DataFrame], partition_by: tuple[str, ...] = ()) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, path = make(spark, sf_dir), scratch_path(spark, "sink")
        sinks.write_table(df, path, partition_by)
        return spark.read.schema(df.schema).parquet(path)

    return run


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(*[provider(spark, sf_dir, n) for n in ("facility", "timely", "survey")])


def _replaced_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel stored with a provisional newest release, which is then replaced by the final one."""
    path = scratch_path(spark, "releases")
    table = materialize(_panel(spark, sf_dir), "panel")
    newest = table.agg(F.max("period")).first()[0]
    provisional = F.when(F.col("period") < newest, F.col("overall_rating"))
    release_store.write_releases(table.withColumn("overall_rating", provisional), path)
    release_store.write_releases(table.filter(F.col("period") == newest), path)
    return release_store.read_releases(spark, path).select(table.columns)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = panel.add_deltas(release_panel(provider(spark, sf_dir, "snapshot")))
    return moved.select("facility_id", "period", "overall_rating", "overall_rating_delta", "composite_risk_score")


def _warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.early_warning(release_panel(provider(spark, sf_dir, "snapshot")))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_hospitals(provider(spark, sf_dir, "facility"), provider(spark, sf_dir, "scored_eval"))


def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(document(spark, sf_dir), path)
    return read_metrics(spark, path)


def sources() -> dict[str, Query]:
    return {
        "src_csv_positional": positional,
        "src_csv_text": text,
        "src_clean": clean_tables,
        "src_archive": archive,
        "src_snapshots": snapshot_folders,
        "src_derived_csv": derived_csv,
        "sink_features": _stored(_features),
        "sink_panel": _stored(_panel, ("period",)),
        "sink_releases": _replaced_releases,
        "sink_trends": _stored(_warned),
        "sink_scored": _stored(_scored),
        "sink_leaderboard": _stored(leaderboard),
        "sink_metrics_json": metrics_json,
    }

"""One folder per release: a ready feature table, or the three published files."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardlens.functions.clean import to_num
from wardlens.plans.features import PER_RELEASE, assemble, load_general, load_hcahps, load_timely
from wardlens.sources.delimited import read_layouts, read_release_csv
from wardlens.sources.schemas import FEATURES, PREBUILT_FILE, RELEASE_FIELDS, RELEASE_FILES, conform


def has_csv(spark: SparkSession, root: str) -> bool:
    """Whether any CSV file lies below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    try:
        return not files.load(root).select("path").isEmpty()
    except AnalysisException:
        return False


def release_files(spark: SparkSession, root: str) -> dict[str, dict[str, list[str]]]:
    """Release label -> {lower-cased file name: paths}, for the published and ready files. Only names are listed.

    A file may be a folder of that name with part files. The label is the name of the folder around it; a
    leading ``period=`` is not part of it. Folders with other CSV files only have an empty entry.
    """
    try:
        listing = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.csv")
            .load(root)
            .select("path")
            .collect()
        )
    except AnalysisException as err:
        raise FileNotFoundError(f"no snapshots at {root}") from err
    known = {PREBUILT_FILE, *RELEASE_FILES.values()}
    found: dict[str, dict[str, list[str]]] = {}
    for (path,) in listing:
        parts = path.split("/")
        at = next((k for k in (-1, -2) if parts[k].lower() in known), None)
        label = parts[-2 if at is None else at - 1].removeprefix("period=")
        files = found.setdefault(label, {})
        if at is not None:
            files.setdefault(parts[at].lower(), []).append(path)
    if not found:
        raise FileNotFoundError(f"{root} holds no release folders")
    return found


def _label() -> Column:
    """Release label of a row from the path of its file."""
    parts = F.split(F.expr("url_decode(replace(row_seq.file, '+', '%2B'))"), "/")
    folder = F.element_at(parts, -2)
    known = [PREBUILT_FILE, *RELEASE_FILES.values()]
    label = F.when(F.lower(F.element_at(parts, -1)).isin(known) | ~F.lower(folder).isin(known), folder)
    return F.regexp_replace(F.coalesce(label, F.element_at(parts, -3)), "^period=", "")


def _features_of(raw: DataFrame) -> DataFrame:
    """Ready feature rows by column name, with their label; ids stay text with their zeros."""
    numbers = {f.name: to_num(f.name) for f in FEATURES if f.dataType.typeName() != "string" and f.name in raw.columns}
    schema = StructType([*FEATURES.fields, StructField("period", StringType())])
    return conform(raw.withColumns({**numbers, "period": _label()}), schema)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A stored feature table, by column name, without a label."""
    return _features_of(read_release_csv(spark, path)).drop("period")


def _fields_of(raw: DataFrame, table: str) -> DataFrame:
    """The fields of one published table under their own names; an absent county is empty, others are NULL."""
    columns = []
    for field, headings in RELEASE_FIELDS[table].items():
        name = next((h for h in (*headings, field) if h in raw.columns), None)
        absent = F.lit("" if field == "county_parish" else None).cast("string")
        columns.append((absent if name is None else raw[f"`{name}`"]).alias(field))
    return raw.select(_label().alias("period"), "row_seq", *columns)


def _read(spark: SparkSession, paths: list[str], shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All given files, each layout read and shaped once."""
    frames = read_layouts(spark, sorted(paths))
    return reduce(DataFrame.unionByName, [shape(f) for f in frames])


def load_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Feature rows of all release folders with their labels as ``period``, in one plan.

    A release is a ready feature table or, failing that, the three published files. Files are read by kind,
    encoding and heading, so the plan is as large for a thousand releases as for one.
    """
    found = release_files(spark, root)
    for label, files in found.items():
        if PREBUILT_FILE not in files and not all(name in files for name in RELEASE_FILES.values()):
            raise FileNotFoundError(f"no usable files for release {label}")
    ready = [p for files in found.values() for p in files.get(PREBUILT_FILE, [])]
    raw = [files for files in found.values() if PREBUILT_FILE not in files]
    frames = []
    if ready:
        frames.append(_read(spark, ready, _features_of))
    if raw:
        tables = {
            table: _read(spark, [p for files in raw for p in files[name]], partial(_fields_of, table=table))
            for table, name in RELEASE_FILES.items()
        }
        loaded = load_general(tables["general"], PER_RELEASE), load_hcahps(tables["survey"], PER_RELEASE), load_timely(tables["timely"], PER_RELEASE)
        frames.append(assemble(*loaded, PER_RELEASE))
    return stack(frames)


def load_release(spark: SparkSession, folder: str) -> DataFrame:
    """Feature table of the one release in ``folder``, without a label."""
    found = release_files(spark, folder)
    if len(found) != 1:
        raise FileNotFoundError(f"{folder} holds {len(found)} releases, not one")
    return load_snapshots(spark, folder).drop("period")


def load_snapshot_table(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows stored as Parquet under ``period=`` folders; a period filter prunes folders."""
    table = spark.read.parquet(path)
    return table.withColumn("period", F.col("period").cast("string"))


def stack(frames: list[DataFrame]) -> DataFrame:
    """All releases under each other; columns match by name, missing ones are NULL."""
    if not frames:
        raise FileNotFoundError("no snapshots to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

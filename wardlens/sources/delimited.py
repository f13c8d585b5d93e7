"""Delimited text readers."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CSV = {"header": True, "quote": '"', "escape": '"'}


def load_table(spark: SparkSession, path: str | list[str], schema: StructType, multi_line: bool = False) -> DataFrame:
    """Quoted CSV into a declared table: the heading is skipped, columns match by position.

    An empty field stays an empty text. ``multi_line`` is only for records that hold
    line breaks, since such files cannot be split.
    """
    raw = spark.read.schema(schema).options(**_CSV, enforceSchema=True, multiLine=multi_line).csv(path)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns])


def row_order() -> Column:
    """Place of a row in its files: file, block start, position in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def file_layouts(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, str], list[str]]:
    """Files below ``path`` by encoding (UTF-8 when every line is valid UTF-8, else ISO-8859-1) and heading line.

    The text source hands over raw bytes, so the test runs split by split on the
    executors; one row per file comes back, with a digest of its first line.
    """
    valid = F.bool_and(F.is_valid_utf8("value"))
    heading = F.min_by(F.md5(F.btrim("value", F.lit(" \t\r")).cast("binary")), F.struct("order.block", "order.row"))
    rows = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value", row_order().alias("order"))
        .groupBy("file")
        .agg(valid.alias("utf8"), heading.alias("heading"))
        .collect()
    )
    found: dict[tuple[str, str], list[str]] = {}
    for row in sorted(rows):
        found.setdefault(("UTF-8" if row.utf8 else "ISO-8859-1", row.heading), []).append(unquote(row.file))
    return found


def file_encodings(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files below ``path`` by encoding."""
    found: dict[str, list[str]] = {}
    for (encoding, _), files in file_layouts(spark, path).items():
        found[encoding] = sorted([*found.get(encoding, []), *files])
    return found


def _heading(name: str) -> str:
    return name.strip().lstrip("﻿").strip().strip('"').strip()


def read_layouts(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> list[DataFrame]:
    """Files below ``path`` as text with trimmed headings, one frame for each pair of encoding and heading.

    ``row_seq`` records file order. The number of frames does not grow with the number of files.
    """
    parts = []
    for (encoding, _), files in file_layouts(spark, path).items():
        raw = spark.read.options(**_CSV, encoding=encoding, multiLine=multi_line).csv(files)
        names = [_heading(c) for c in raw.columns]
        parts.append(raw.select("*", row_order().alias("row_seq")).toDF(*names, "row_seq"))
    if not parts:
        raise FileNotFoundError(f"no rows found at {path}")
    return parts


def read_release_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """One release file (or several) as text, with trimmed headings, in file order by ``row_seq``.

    Files of both encodings and with different headings may lie side by side: each heading is read
    with its own files, and columns match by name.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read_layouts(spark, path, multi_line))

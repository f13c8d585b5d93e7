"""Nested release archives: annual zips that hold release zips that hold the three published files.

1. Chunk table. Archives are read as lines of raw bytes, so they are split like any text file, have no size
   limit, and no task holds more than a chunk: rows ``archive, offset, size, data``.
2. Directories. The end of an archive tells where its directory begins; from there on its chunks list the
   members. Each member's stretch is cut out of the chunks it lies in by a join on the archive and a grid of offsets.
3. Releases. Stretches meet by member in order, are inflated, and written as ``archive, member, period, usable,
   chunk, data``. Usable releases hold all three files; of a label the last in name order is chosen.
4. Rows. Chosen releases are dealt to at most ``TASKS`` tasks and parsed one after another, in pieces; rows are stored by
   table, so each table is scanned alone and the number of files does not follow that of the releases.

Zip members can only be opened by a library, so Python runs in the executors. One release zip (not its
content) is in memory at a time.
"""

from __future__ import annotations

import bz2
import codecs
import csv
import io
import pathlib
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.functions.periods import PERIOD_PATTERN
from wardlens.plans.features import PER_RELEASE, assemble, load_general, load_hcahps, load_timely
from wardlens.sources.schemas import RELEASE_FIELDS, RELEASE_FILES
from wardlens.sources.scratch import materialize, scratch_path
from wardlens.sources.sinks import write_table

ARCHIVE_GLOB = "hospitals_annual_*.zip"
CHUNK_ROWS = 20_000
CHUNK_BYTES = 4 << 20
READ_BYTES = 4 << 20
TASKS = 1_000
TAIL = 66_000  # the end records of an archive, with the longest comment, lie in its last bytes

FIELDS = tuple(dict.fromkeys(f for fields in RELEASE_FIELDS.values() for f in fields))
ROWS_SCHEMA = (
    "archive string, member string, row_seq bigint, "
    + ", ".join(f"{f} string" for f in FIELDS)
    + ", table_name string, period string"
)
_MEMBER = "archive string, member string, begins long, ends long, method int, packed long"
_RELEASES = "archive string, member string, period string, usable boolean, chunk int, data binary"


def archive_chunks(spark: SparkSession, folder: str, glob: str = ARCHIVE_GLOB, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``archive, file_size, offset, size, data``: the bytes of all archives of a folder, in chunks.

    A chunk ends after ``chunk_bytes`` at the next line feed byte.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(folder)
    rows = lines.select(
        F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"),
    )
    schema = "archive string, file_size long, block long, chunk long, size long, data binary"
    stored = materialize(rows.mapInArrow(lambda batches: _join_lines(batches, chunk_bytes), schema), "archive-chunks")
    # Places come from the sizes alone; an archive has one narrow row per chunk.
    before = Window.partitionBy("archive").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    places = stored.select("archive", "block", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return stored.join(places, ["archive", "block", "chunk"]).select("archive", "file_size", "offset", "size", "data")


def _join_lines(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Lines of a file split, end to end with their line feeds, in chunks."""
    names = ["archive", "file_size", "block", "chunk", "size", "data"]
    key, number, held, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, (*key, number, size, b"".join(held))))])

    for batch in batches:
        for *now, line in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            if now != key or size >= chunk_bytes:
                if held:
                    yield row()
                number = number + 1 if now == key else 0
                key, held, size = now, [], 0
            held += (line, b"\n")
            size += len(line) + 1
    if held:
        yield row()


def _from_tail(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the directory of an archive begins, from its last chunks."""
    pdf = pdf.sort_values("offset")
    data, first = b"".join(pdf["data"]), int(pdf["offset"].iloc[0])
    at = data.rfind(b"PK\5\6")
    if at < 0:
        raise zipfile.BadZipFile(f"no end record in {pdf['archive'].iloc[0]}")
    (length,) = struct.unpack_from("<I", data, at + 12)
    wide = data.rfind(b"PK\6\6", 0, at)
    if wide >= 0 and data[at - 20 : at - 16] == b"PK\6\7":
        (length,), at = struct.unpack_from("<Q", data, wide + 40), wide
    return pd.DataFrame({"archive": pdf["archive"].iloc[:1], "directory": [first + at - length]})


class _Stretches(io.RawIOBase):
    """A file of which only some stretches are there; the rest reads as zeros."""

    def __init__(self, offsets: list[int], parts: list[bytes], size: int) -> None:
        self.parts, self.size, self.at = list(zip(offsets, parts)), size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def read(self, n: int = -1) -> bytes:
        rest = max(0, self.size - self.at)
        out = bytearray(rest if n is None or n < 0 else min(n, rest))
        for start, data in self.parts:
            piece = data[max(0, self.at - start) : max(0, self.at + len(out) - start)]
            into = max(0, start - self.at)
            out[into : into + len(piece)] = piece
        self.at += len(out)
        return bytes(out)


def _directory(pdf: pd.DataFrame) -> pd.DataFrame:
    """Release zips listed in an archive's directory, with the stretch from their header to the next one."""
    pdf = pdf.sort_values("offset")
    archive, begins = pdf["archive"].iloc[0], int(pdf["directory"].iloc[0])
    with zipfile.ZipFile(_Stretches(pdf["offset"].tolist(), pdf["data"].tolist(), int(pdf["file_size"].iloc[0]))) as annual:
        listed = annual.infolist()
    starts = sorted({m.header_offset for m in listed} | {begins})
    after = dict(zip(starts, starts[1:]))
    rows = [
        (archive, m.filename, m.header_offset, after[m.header_offset], m.compress_type, m.compress_size)
        for m in listed
        if m.filename.lower().endswith(".zip")
    ]
    return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in _MEMBER.split(", ")])


def archive_members(chunks: DataFrame) -> DataFrame:
    """``archive, member, begins, ends, method, packed`` of the release zips of all archives."""
    ends = F.col("offset") + F.col("size")
    tails = chunks.where(ends > F.col("file_size") - TAIL).groupBy("archive").applyInPandas(_from_tail, "archive string, directory long")
    listing = chunks.join(tails, "archive").where(ends > F.col("directory"))
    return listing.groupBy("archive").applyInPandas(_directory, _MEMBER)


def _stretches(chunks: DataFrame, members: DataFrame, chunk_bytes: int) -> DataFrame:
    """``archive, member, method, packed, place, piece``: the bytes of each member, cut out of the chunks."""
    longest = chunks.agg(F.max("size")).scalar()
    cell = lambda c: F.floor(c / F.lit(chunk_bytes))
    first = F.greatest(F.col("begins") - longest, F.lit(0))
    wanted = members.withColumn("cell", F.explode(F.sequence(cell(first), cell(F.col("ends") - 1))))
    both = chunks.withColumn("cell", cell(F.col("offset"))).join(wanted, ["archive", "cell"])
    end = F.col("offset") + F.col("size")
    both = both.where((F.col("offset") < F.col("ends")) & (end > F.col("begins")))
    place = F.greatest("offset", "begins")
    piece = F.substring("data", (place - F.col("offset") + 1).cast("int"), (F.least(end, F.col("ends")) - place).cast("int"))
    return both.select("archive", "member", "method", "packed", place.alias("place"), piece.alias("piece"))


def _period(member: str) -> str:
    dated = re.search(PERIOD_PATTERN, member)
    return dated.group(1) if dated else pathlib.PurePosixPath(member).stem


def _inflated(raw: bytearray, method: int, packed: int) -> bytes:
    """Content of a member from its header on."""
    names = struct.unpack_from("<HH", raw, 26)
    body = memoryview(raw)[30 + sum(names) :][:packed]
    if method == zipfile.ZIP_STORED:
        return bytes(body)
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(body, -15)
    if method == zipfile.ZIP_BZIP2:
        return bz2.decompress(body)
    raise NotImplementedError(f"zip method {method}")


def _members(release: zipfile.ZipFile) -> dict[str, str]:
    """Table -> member for the three files; empty unless all three are there."""
    names = {file: table for table, file in RELEASE_FILES.items()}
    hits = [(names[base], m) for m in release.namelist() if (base := m.split("/")[-1].lower()) in names]
    found = dict(hits)
    return found if set(found) == set(names.values()) else {}


def _inflate(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Releases from the stretches of their members, which come in order."""

    def done() -> Iterator[pa.RecordBatch]:
        archive, member, method, packed = key
        content = _inflated(raw, method, packed)
        with zipfile.ZipFile(io.BytesIO(content)) as release:
            usable = bool(_members(release))
        names = [f.split(" ")[0] for f in _RELEASES.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.binary()]
        for k in range(0, len(content), chunk_bytes):
            row = (archive, member, _period(member), usable, k // chunk_bytes, content[k : k + chunk_bytes])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    key, raw = None, bytearray()
    for batch in batches:
        for *now, piece in zip(*[batch.column(k).to_pylist() for k in range(5)]):
            if now != key:
                if key is not None:
                    yield from done()
                key, raw = now, bytearray()
            raw += piece
    if key is not None:
        yield from done()


def releases(chunks: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Stored chunks of all release zips: ``archive, member, period, usable, chunk, data``."""
    members = materialize(archive_members(chunks), "archive-members")
    pieces = _stretches(chunks, members, chunk_bytes).repartition("archive", "member").sortWithinPartitions("archive", "member", "place")
    pieces = pieces.select("archive", "member", "method", "packed", "piece")
    return materialize(pieces.mapInArrow(lambda batches: _inflate(batches, chunk_bytes), _RELEASES), "releases")


def choose(found: DataFrame) -> DataFrame:
    """``archive, member, task`` of the releases to parse: of each label the last usable archive and member in name
    order, numbered from 0."""
    heads = found.where("usable AND chunk = 0").groupBy("period").agg(F.max(F.struct("archive", "member")).alias("s"))
    # One row per release label: the window is as small as the list of releases.
    return heads.select("s.*", (F.row_number().over(Window.orderBy("period")) - 1).alias("task"))


def _encoding(release: zipfile.ZipFile, member: str) -> str:
    """UTF-8 when the whole member decodes, else ISO-8859-1; read in blocks."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    with release.open(member) as source:
        try:
            while block := source.read(1 << 20):
                decoder.decode(block)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return "latin-1"
    return "utf-8-sig"


def _plain_rows(release: zipfile.ZipFile, member: str, encoding: str) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """Headings and text columns of a file whose records all have as many fields as its heading line. Raises
    ``pa.ArrowInvalid`` at the first piece of any other file."""
    with release.open(member) as source:
        try:
            names = next((r for r in csv.reader(io.TextIOWrapper(source, encoding, newline="")) if r), [])
        except csv.Error as e:
            raise pa.ArrowInvalid(str(e)) from e
    if len(names) < 2:
        raise pa.ArrowInvalid("no heading line")
    keys = [str(k) for k in range(len(names))]
    with release.open(member) as source:
        batches = arrow_csv.open_csv(
            source,
            arrow_csv.ReadOptions(use_threads=False, block_size=READ_BYTES, column_names=keys, encoding=encoding.removesuffix("-sig")),
            arrow_csv.ParseOptions(newlines_in_values=True),
            arrow_csv.ConvertOptions(column_types=dict.fromkeys(keys, pa.string()), strings_can_be_null=False),
        )
        for k, batch in enumerate(batches):
            yield names, batch.slice(0 if k else 1)  # the heading line comes as the first record


def _uneven_rows(release: zipfile.ZipFile, member: str, encoding: str, done: int) -> Iterator[tuple[list[str], pa.RecordBatch]]:
    """The same for any file, after its first ``done`` rows; fields that a record lacks are missing."""
    with release.open(member) as source:
        for chunk in pd.read_csv(source, dtype=str, keep_default_na=False, encoding=encoding, chunksize=CHUNK_ROWS):
            names, chunk, done = list(chunk.columns), chunk.iloc[done:], max(0, done - len(chunk))
            columns = [pa.array(chunk.iloc[:, k], pa.string(), from_pandas=True) for k in range(len(names))]
            yield names, pa.RecordBatch.from_arrays(columns, [str(k) for k in range(len(names))])


def _release_rows(release: zipfile.ZipFile) -> Iterator[tuple[str, pa.Array, list[pa.Array]]]:
    """(table, place of each row in its file, FIELDS) of the three files, in pieces."""
    for table, member in _members(release).items():
        encoding, done = _encoding(release, member), 0

        def shaped(names: list[str], batch: pa.RecordBatch) -> tuple[str, pa.Array, list[pa.Array]]:
            bare = [n.strip() for n in names]
            found = [next((h for h in RELEASE_FIELDS[table].get(f, ()) if h in bare), None) for f in FIELDS]
            columns = [batch.column(bare.index(h)) if h else pa.nulls(batch.num_rows, pa.string()) for h in found]
            return table, pa.array(range(done, done + batch.num_rows), pa.int64()), columns

        try:
            for names, batch in _plain_rows(release, member, encoding):
                yield shaped(names, batch)
                done += batch.num_rows
        except pa.ArrowInvalid:
            for names, batch in _uneven_rows(release, member, encoding, done):
                yield shaped(names, batch)
                done += batch.num_rows


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the releases whose chunks come in order."""
    names = [f.strip().split(" ")[0] for f in ROWS_SCHEMA.split(",")]

    def done() -> Iterator[pa.RecordBatch]:
        archive, member, period = key
        with zipfile.ZipFile(io.BytesIO(b"".join(held))) as release:
            for table, places, columns in _release_rows(release):
                same = [pa.repeat(pa.scalar(v, pa.string()), len(places)) for v in (archive, member, table, period)]
                yield pa.RecordBatch.from_arrays([*same[:2], places, *columns, *same[2:]], names)

    key, held = None, []
    for batch in batches:
        for *now, data in zip(*[batch.column(c).to_pylist() for c in ("archive", "member", "period", "data")]):
            if now != key:
                if key is not None:
                    yield from done()
                key, held = now, []
            held.append(data)
    if key is not None:
        yield from done()


def unpack_archives(chunks: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of all chosen releases, stored by table: archive, member, row_seq and the text fields."""
    found = releases(chunks, chunk_bytes)
    chosen = materialize(choose(found), "chosen")
    path = scratch_path(chunks.sparkSession, "archive-rows")
    each = found.join(chosen, ["archive", "member"]).select("task", "archive", "member", "period", "chunk", "data")
    tasks = min(max(1, chosen.count()), TASKS)
    each = each.repartitionById(tasks, F.col("task") % tasks).sortWithinPartitions("task", "chunk")
    each.mapInArrow(_parse, ROWS_SCHEMA).write.partitionBy("table_name").parquet(path)
    return chunks.sparkSession.read.schema(ROWS_SCHEMA).parquet(path)


def release_table(rows: DataFrame, table: str) -> DataFrame:
    """One of the three tables with the fields the feature pipeline needs; other tables' files are not read."""
    return rows.filter(F.col("table_name") == table).select("period", "row_seq", *RELEASE_FIELDS[table])


def features_of_archives(chunks: DataFrame) -> DataFrame:
    """Feature table of every release, with its label as ``period``."""
    rows = unpack_archives(chunks)
    return assemble(
        load_general(release_table(rows, "general"), PER_RELEASE),
        load_hcahps(release_table(rows, "survey"), PER_RELEASE),
        load_timely(release_table(rows, "timely"), PER_RELEASE),
        PER_RELEASE,
    )


def build_snapshots(spark: SparkSession, folder: str, out: str, glob: str = ARCHIVE_GLOB) -> None:
    """Feature rows of every release in the archives of ``folder``, stored under ``period=`` folders."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    if names.isEmpty():
        raise FileNotFoundError(f"no {glob} in {folder}")
    write_table(features_of_archives(archive_chunks(spark, folder, glob)), out, ["period"])

"""WARC archives of web pages, written and read as a table of record chunks (operator 5).

A payload becomes rows of record identifier and chunk number with at most ``chunk`` bytes
each. Every chunk is one WARC record (a response and its continuations, as WARC segments
long payloads), written by Spark's text writer as gzip files: a record's last line feed is the
writer's line end. So archives go to any file system Spark can write, and a lost task is
written again. Pages whose payload an earlier page has (smallest page_id) become revisit
records without payload.

Reading streams the lines of a file in order and follows the stated lengths, so lines inside
a payload that look like records mean nothing. The digest is carried from chunk to chunk, and
no more than one line is held; a digest that differs from the record's is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm.tables import materialize, scratch_path

CHUNK = 1 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHUNKS = (
    "record_id string, record_type string, refers_to string, chunk_no int, last boolean, "
    "n_bytes long, digest string, chunk binary"
)


def base32_of_hex(hex_text: Column) -> Column:
    """Base32 of 40 hexadecimal digits: five digits are four letters."""
    letters = []
    for group in range(8):
        value = F.conv(F.substring(hex_text, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_ALPHABET), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def with_targets(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """``id, payload, n_bytes, hex`` and ``first``: the smallest id with the same payload, where it is another one.

    Only payloads that occur more than once are kept for the join, as digest and id; that
    table is written first, so Spark knows its size before it plans the join.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select("*", F.col(id_col).cast("long").alias("_id"), body.alias("_payload"))
    rows = rows.withColumns({"_hex": F.sha1("_payload"), "_n": F.octet_length("_payload").cast("long")})
    again = rows.where(F.col("_n") >= least).groupBy("_hex", "_n").agg(F.min("_id").alias("_first"), F.count("*").alias("_times"))
    again = materialize(again.where("_times > 1").select(F.col("_hex").alias("_h"), F.col("_n").alias("_m"), "_first"), "repeats")
    rows = rows.join(again, (rows["_hex"] == again["_h"]) & (rows["_n"] == again["_m"]), "left").drop("_h", "_m")
    return rows.withColumn("_first", F.when(F.col("_first") != F.col("_id"), F.col("_first")))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    payload_col: str = "html",
    url_col: str | None = "url",
    least: int = 0,
    chunk: int = CHUNK,
) -> None:
    """Write one WARC record per page (further chunks of long payloads as continuations) below ``path``.

    A null payload is empty. A page without id is a response under an empty identifier. Of
    repeated rows with one id each is written. Other columns are not read.
    """
    kept = [id_col, payload_col] + ([url_col] if url_col else [])
    renamed = pages.select(*(F.col(c).alias(f"_in{k}") for k, c in enumerate(kept)))
    rows = with_targets(renamed, "_in0", "_in1", least)
    revisit = F.col("_first").isNotNull()
    last = F.when(revisit, F.lit(0)).otherwise(F.greatest(F.ceil(F.col("_n") / chunk) - 1, F.lit(0))).cast("int")
    rows = rows.withColumn("_last", last)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_no"))
    part = F.when(revisit, F.lit(b"")).otherwise(F.substring("_payload", F.col("_no") * chunk + 1, F.lit(chunk)))
    rows = rows.withColumn("_part", part)
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    further, many = F.col("_no") > 0, F.col("_last") > 0
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    digest = F.concat(F.lit("sha1:"), base32_of_hex(F.col("_hex")))
    url = F.regexp_replace(F.col("_in2").cast("string"), "[\r\n]", "") if url_col else F.lit(None).cast("string")
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").when(further, "continuation").otherwise("response")),
        line("WARC-Record-ID", F.concat(name, F.when(further, F.concat(F.lit(":"), F.col("_no") + 1)).otherwise(""), F.lit(">"))),
        line("WARC-Target-URI", url),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first"), F.lit(">")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Payload-Digest", digest),
        line("X-Payload-Length", F.col("_n")),
        F.when(many, line("WARC-Segment-Number", F.col("_no") + 1)),
        F.when(further, line("WARC-Segment-Origin-ID", F.concat(name, F.lit(">")))),
        F.when(further & (F.col("_no") == F.col("_last")), line("WARC-Segment-Total-Length", F.col("_n"))),
        F.lit("Content-Type: text/html"),
        line("Content-Length", F.octet_length("_part")),
        F.lit("\r\n"),
    )
    record = F.concat(header.cast("binary"), F.col("_part"), F.lit(b"\r\n\r"))
    out = rows.select(record.cast("string").alias("value"))
    out.write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Reader:
    """Follows WARC records line by line; one instance reads files one after another."""

    def __init__(self, with_payload: bool) -> None:
        self.with_payload, self.path, self.rows = with_payload, None, []
        self.header, self.open, self.left = None, None, 0

    def line(self, path: str, line: bytes) -> None:
        """Take the next line, without its line feed."""
        if path != self.path:
            self.end()
            self.path = path
        if self.left > 0:
            body = line + b"\n"
            part = body[: self.left]
            self._payload(part)
            self.left -= len(part)
            if self.left == 0 and len(part) < len(body):
                self._trailer(body[len(part) :])
        elif self.header is not None:
            if line == b"\r":
                header, self.header = self.header, None
                self._start(header)
            else:
                key, _, value = line.rstrip(b"\r").partition(b": ")
                self.header[key.decode()] = value.decode()
        elif line.startswith(b"WARC/1."):
            self.header = {}
        elif line != b"\r":
            raise ValueError(f"no WARC record where one should start in {path}")

    def _trailer(self, rest: bytes) -> None:
        if rest != b"\r\n":
            raise ValueError(f"a record's length is wrong in {self.path}")

    def _start(self, header: dict[str, str]) -> None:
        length, kind = int(header["Content-Length"]), header["WARC-Type"]
        if kind == "continuation":
            self.open["chunk_no"] += 1
            if int(header["WARC-Segment-Number"]) != self.open["chunk_no"] + 1:
                raise ValueError(f"a segment is missing in {self.path}")
            self._flush(False)
        else:
            self.end()
            self.open = {"header": header, "chunk_no": 0, "n": 0, "sha": hashlib.sha1()}
            self.open["parts"] = []
        self.left = length

    def _payload(self, part: bytes) -> None:
        self.open["sha"].update(part)
        self.open["n"] += len(part)
        if self.with_payload:
            self.open["parts"].append(part)

    def _flush(self, last: bool) -> None:
        now, header = self.open, self.open["header"]
        shown = now["chunk_no"] if last else now["chunk_no"] - 1
        name = lambda key: header[key].removeprefix("<urn:page:").removesuffix(">") if key in header else None
        size, digest = now["n"], base64.b32encode(now["sha"].digest()).decode()
        if header["WARC-Type"] == "revisit":
            size, digest = int(header["X-Payload-Length"]), header["WARC-Payload-Digest"].removeprefix("sha1:")
        elif last and "sha1:" + digest != header["WARC-Payload-Digest"]:
            raise ValueError(f"the payload of {header['WARC-Record-ID']} differs from its digest in {self.path}")
        self.rows.append(
            {
                "record_id": name("WARC-Record-ID"), "record_type": header["WARC-Type"], "refers_to": name("WARC-Refers-To"),
                "chunk_no": shown, "last": last, "n_bytes": size, "digest": digest,
                "chunk": b"".join(now["parts"]) if self.with_payload else None,
            }
        )
        now["parts"] = []

    def end(self) -> None:
        """Close the record that is open."""
        if self.left or self.header is not None:
            raise ValueError(f"a record is cut off in {self.path}")
        if self.open:
            self._flush(True)
            self.open = None


def read_chunks(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The chunks of all records below ``path``: ``record_id, record_type, refers_to, chunk_no, last, n_bytes,
    digest, chunk``; size and digest are those of the payload up to and with the chunk."""
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _CHUNKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = _Reader(with_payload), 0
        for batch in batches:
            for path, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader.line(path, line.as_py())
                held += len(line.as_py()) if with_payload else 0
                if len(reader.rows) >= 4096 or held > 8 * CHUNK:
                    yield pa.RecordBatch.from_pylist(reader.rows, schema)
                    reader.rows, held = [], 0
        reader.end()
        if reader.rows:
            yield pa.RecordBatch.from_pylist(reader.rows, schema)

    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(run, _CHUNKS)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page, from archives written and read back.

    An empty table gives an empty archive and an empty result.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path, **options)
    whole = read_chunks(spark, path, with_payload=False).where("last")
    return whole.select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"),
    )

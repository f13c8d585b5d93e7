"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (a run of letters A-Z a-z, or one other code point) and at two places drawn
from the hashed id into prefix, middle and suffix. ``plain`` keeps the text; ``psm`` writes ``<P>`` prefix
``<S>`` suffix ``<M>`` middle, ``spm`` writes ``<S>`` suffix ``<P>`` prefix ``<M>`` middle. Texts that are
empty or hold one of the marks stay plain.

* Cutting emits pieces of whole units, at most PIECE_BYTES long (a longer unit is split), keyed by document
  and place in the output. No task ever joins the pieces of a document.
* Pieces are dealt by document and sorted by place within the partition (repartition and sort within
  partitions); a partition streams them into one running digest.
* The assembled stream is then read back: its marks tell which part a piece belongs to, and pieces are sorted
  again, in the same partition, by the place that gives the text. A second running digest is that of the
  restored text. Texts cross the network once.

A document's key is its id and the digest of its text, so rows that share an id stay apart. Equal rows have equal
pieces: they are sent once per batch with their number, assembled once and returned as often as they came.
A null text is an empty one; a null id is hashed as an empty one. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm import arrays

PIECE_BYTES = 1 << 16
MARKS = (b"<P>", b"<M>", b"<S>")  # prefix, middle, suffix, in the order of the text
PLAIN, PSM, SPM = "plain", "psm", "spm"
OUTPUT_ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}  # parts, numbered as MARKS
SEED = "1"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
_PART = 40  # bits of a place below its part

_DOC = "doc_id long, sign binary"
_ABOUT = "n long, form string, prefix_chars long, middle_chars long"
_PIECES = f"{_DOC}, place long, times long, {_ABOUT}, piece binary"
_ASSEMBLED = f"{_PIECES}, output_sha256 string"
_RESULT = f"doc_id long, {_ABOUT}, output_sha256 string, restored_sha256 string"


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers below 2**32 from seed and id."""
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[k : k + 8], 16) for k in range(0, 32, 8)]


def _letter(data: np.ndarray) -> np.ndarray:
    low = data | 0x20
    return (low >= 97) & (low <= 122)


def _marks(data: np.ndarray) -> np.ndarray:
    """Places where a mark begins, in rising order."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    first = np.flatnonzero((data[:-2] == MARKS[0][0]) & (data[2:] == MARKS[0][2]))
    return first[np.isin(data[first + 1], [m[1] for m in MARKS])]


def _bytes_of(size: int, units: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of [low, high) that end between units; ``units`` are the starts of all units."""
    while high - low > size:
        at = units[np.searchsorted(units, low + size, "right") - 1]
        cut = int(at) if at > low else low + size
        yield low, cut
        low = cut
    yield low, high


def _cut(batches: Iterator[pa.RecordBatch], seed: str, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = arrays.buffers(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for first, last in arrays.blocks(offsets):
            low = offsets[first]
            rows = _cut_block(ids[first:last], data[low : offsets[last]], offsets[first : last + 1] - low, seed, size)
            yield from _table(rows, _PIECES)


def _cut_block(ids: list, data: np.ndarray, offsets: np.ndarray, seed: str, size: int) -> Iterator[tuple]:
    """Pieces of some whole texts, as rows of _PIECES."""
    lead = (data & 0xC0) != 0x80
    letter = _letter(data)
    starts = lead.copy()
    starts[1:] &= ~(letter[1:] & letter[:-1])
    edge = offsets[:-1][offsets[:-1] < len(data)]
    starts[edge] = True
    units = np.flatnonzero(starts)
    chars = np.flatnonzero(lead)
    marks = _marks(data)
    raw = data.tobytes()
    bounds = np.searchsorted(units, offsets)
    seen: dict[tuple, int] = {}
    signs = []
    for k, doc in enumerate(ids):
        signs.append(hashlib.sha256(memoryview(raw)[offsets[k] : offsets[k + 1]]).digest())
        seen[doc, signs[k]] = seen.get((doc, signs[k]), 0) + 1
    for k, doc in enumerate(ids):
        times = seen.pop((doc, signs[k]), 0)
        if not times:
            continue  # the first of equal rows has sent them
        low, high = int(offsets[k]), int(offsets[k + 1])
        mine = units[bounds[k] : bounds[k + 1]]
        n = len(mine)
        h = draws(doc, seed)
        at = int(np.searchsorted(marks, low))
        marked = at < len(marks) and marks[at] + 3 <= high
        if n == 0 or marked or h[2] % 100 >= PLAIN_FROM:
            about, parts = (n, PLAIN, None, None), [(b"", low, high)]
        else:
            form = SPM if h[3] % 100 < SPM_BELOW else PSM
            ends = [int(mine[u]) if u < n else high for u in sorted((h[0] % (n + 1), h[1] % (n + 1)))]
            cuts = [low, *ends, high]
            count = np.diff(np.searchsorted(chars, cuts))
            about = (n, form, int(count[0]), int(count[1]))
            parts = [(MARKS[p], cuts[p], cuts[p + 1]) for p in OUTPUT_ORDER[form]]
        for part, (mark, a, b) in enumerate(parts):
            for j, (x, y) in enumerate(_bytes_of(size, mine, a, b)):
                yield doc, signs[k], (part << _PART) + j, times, *about, (mark if j == 0 else b"") + raw[x:y]


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _table(rows: Iterator[tuple], schema: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes from rows in the order of a schema."""
    fields = [f.split(" ") for f in schema.split(", ")]
    pa_schema = pa.schema([(name, _TYPES[kind]) for name, kind in fields])
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += 100 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), pa_schema)], schema=pa_schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), pa_schema)], schema=pa_schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _assembled(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of _ASSEMBLED: pieces in output order go on with their place in the text, then a closing row."""
    key = last = digest = about = None
    times = part = 0
    for doc, sign, place, count, n, form, prefix, middle, piece in rows:
        if (doc, sign) != key:
            if key is not None:
                yield *key, 3 << _PART, times, *about, None, digest.hexdigest()
            key, last, digest, about, times, part = (doc, sign), -1, hashlib.sha256(), (n, form, prefix, middle), 0, 0
        if place == 0:
            times += count
        if place == last:
            continue  # the same piece of an equal row
        last = place
        digest.update(piece)
        if form != PLAIN and piece[:3] in MARKS:  # read back from the output: texts with marks are plain
            part, piece = MARKS.index(piece[:3]), piece[3:]
        yield doc, sign, (part << _PART) + (place & ((1 << _PART) - 1)), 0, None, None, None, None, piece, None
    if key is not None:
        yield *key, 3 << _PART, times, *about, None, digest.hexdigest()


def _restored(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of _RESULT from rows of _ASSEMBLED in the order of the text."""
    digest = hashlib.sha256()
    for doc, _, _, times, n, form, prefix, middle, piece, output in rows:
        if output is None:
            digest.update(piece)
            continue
        row = doc, n, form, prefix, middle, output, digest.hexdigest()
        for _ in range(times):
            yield row
        digest = hashlib.sha256()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, size: int = PIECE_BYTES) -> DataFrame:
    """The transformed texts as pieces in order: ``doc_id, sign, place, times, n, form, prefix_chars, middle_chars, piece``.

    All pieces of a document lie in one partition, sorted by place; put end to end they are its output.
    ``times`` is the number of equal rows a piece stands for; pieces of equal rows of different batches may repeat.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    cut = rows.mapInArrow(lambda batches: _cut(batches, seed, size), _PIECES)
    return cut.repartition("doc_id", "sign").sortWithinPartitions("doc_id", "sign", "place")


def digests(sorted_pieces: DataFrame) -> DataFrame:
    """A row per document of ``pieces()``: its numbers, the digest of its output and that of the text restored from it."""
    assembled = sorted_pieces.mapInArrow(lambda b: _table(_assembled(_rows(b)), _ASSEMBLED), _ASSEMBLED)
    again = assembled.sortWithinPartitions("doc_id", "sign", "place")
    return again.mapInArrow(lambda b: _table(_restored(_rows(b)), _RESULT), _RESULT)

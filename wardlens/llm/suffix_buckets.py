"""Removal of repeated byte strings by bucket-pointer refinement (operator 6).

Candidate regions come from content-chosen anchors (``anchors``), so all occurrences of a
recurring 200-byte string meet in one shard. In a shard the suffixes are put into buckets by
their first q = 8 bytes. Each pass then sorts the suffixes of every bucket on the bucket
identifier of the suffix ``offset`` bytes further on; with offset equal to the depth reached,
the depth doubles, and the identifiers of one pass are the keys of the next (8, 16, 32, 64,
128 and, with offset 72, 200 bytes). A suffix alone in its bucket is finished and is sorted no
more. Strings that still share a bucket at full depth are equal byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm import anchors
from wardlens.llm.tables import unique_documents

PER_SHARD = 4_000
Q = 8


def _pointers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifier of every key (place of its bucket in sorted order), and whether it is shared."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    bucket = np.empty(len(keys), np.uint32)
    shared = np.empty(len(keys), bool)
    bucket[order] = np.repeat(first, sizes)
    shared[order] = np.repeat(sizes > 1, sizes)
    return bucket, shared


def refine(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Whether the ``depth`` bytes from each position occur at another position too.

    ``ends`` is the end of the text piece of each position; strings past it count as unique.
    """
    n = len(data)
    flags = np.zeros(n, bool)
    position = np.arange(n)
    reach = min(Q, depth)
    alive = position[position + reach <= ends]
    if not len(alive):
        return flags
    keys = np.zeros(len(alive), np.uint64)
    for j in range(reach):
        keys = (keys << np.uint64(8)) | data[alive + j].astype(np.uint64)
    while True:
        bucket = np.zeros(n, np.uint32)
        valid = np.zeros(n, bool)
        own, shared = _pointers(keys)
        alive, own = alive[shared], own[shared]
        bucket[alive], valid[alive] = own, True
        if reach == depth:
            flags[alive] = True
            return flags
        offset = min(reach, depth - reach)
        later = np.minimum(alive + offset, n - 1)
        go = (alive + reach + offset <= ends[alive]) & valid[later]
        alive = alive[go]
        if not len(alive):
            return flags
        keys = (bucket[alive].astype(np.uint64) << np.uint64(32)) | bucket[alive + offset]
        reach += offset


def locate(shard: anchors.Shard, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the shard that occur elsewhere: (segment, first window inside it, number).

    Equal segments stand for each other: their windows all recur, and one of them takes part.
    """
    none = np.zeros(0, np.int64)
    if not len(shard.ids):
        return none, none, none
    raw = shard.data.tobytes()
    bounds = shard.offsets.tolist()
    seen: dict[bytes, int] = {}
    of = np.fromiter(
        (seen.setdefault(raw[a:b], k) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))), np.int64
    )
    times = np.bincount(of, minlength=len(of))
    lead = np.unique(of)
    del seen
    sizes = np.diff(shard.offsets)[lead]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(offsets[-1]) + np.repeat(shard.offsets[lead] - offsets[:-1], sizes)
    flags = refine(shard.data[index], np.repeat(offsets[1:], sizes), window)
    number = np.zeros(len(of), np.int64)
    number[lead] = np.arange(len(lead))
    whole = (times[of] > 1) | shard.repeated
    n_windows = np.asarray(shard.counts, np.int64)
    segment = np.repeat(np.arange(len(of)), n_windows)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    again = whole[segment] | flags[offsets[number[of[segment]]] + inside]
    first, n = anchors.consecutive(again, segment)
    return segment[first], inside[first], n


def _apply(window: int):
    """Kept bytes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digests = [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                body = text.as_py()
                size.append(len(body))
                if not runs:
                    removed.append(0)
                    spans.append(0)
                    digests.append(hashlib.sha256(body).hexdigest())
                    continue
                gone = anchors.covered(runs, window, len(body))
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(np.frombuffer(body, np.uint8)[~gone].tobytes()).hexdigest())
            columns = [pa.array(x, pa.int64()) for x in (size, removed, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 200,
    gram: int = 32,
    per_shard: int = PER_SHARD,
    hot: int = 20_000,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document.

    A null text has no bytes. Rows with equal ids count as one document with the greatest of
    their texts; rows without an id are returned as they are, with nothing removed and no part
    in the comparison. Other columns are not read; an empty table gives an empty one.
    """
    known, nameless = unique_documents(docs, id_col, text_col)
    shape = anchors.Shape(words=False, window=window, gram=gram, hot=hot)
    found = anchors.recurring(known, shape)
    runs = anchors.repeated_windows(known, found, shape, lambda shard: locate(shard, window), per_shard)
    rows = known.join(runs, "doc_id", "left").unionByName(nameless, allowMissingColumns=True)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "runs")
    return rows.mapInArrow(_apply(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

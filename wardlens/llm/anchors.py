"""Candidate regions for repeats of long item runs, found through content-chosen anchors.

Items are the words or the bytes of a document; a window is ``window`` consecutive items. Of
the runs of ``gram`` items inside a window, the one with the smallest hash (the leftmost of
equal ones) is the window's anchor. It depends on the window's content alone, so equal
windows have equal anchors at equal places: a window can only recur if its anchor does. About
two of ``window - gram + 2`` positions are anchors, and only these are shuffled.

1. ``recurring``: anchors are bucketed by hash and packed into a few binary rows per Arrow
   batch. Inside a batch only the first occurrence of an anchor goes to the anchor's bucket,
   with the number of occurrences it stands for; later ones are known to recur and pass
   through buckets of their own documents. A bucket so receives each anchor once per batch at
   most, however frequent it is.
2. ``segments``: for every recurring anchor, the piece of text that covers the windows it is
   the anchor of goes to a shard chosen by the anchor, so all occurrences of a window meet in
   one shard. Windows of very frequent anchors travel one by one, sharded by their own hash.
   Of equal segments in a batch only the first travels; the operator is told of the others. Hashes only
   propose what may be equal: text is compared before anything counts as a repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm import arrays
from wardlens.llm.tables import materialize

PIECE = 1 << 22
FLUSH = 1 << 19
BODY_BYTES = 16 << 20
_PLACE = np.uint64((1 << 26) - 1)
PACKED = "bucket long, kind int, n long, data binary, ids binary, starts binary, counts binary, sizes binary"


@dataclass(frozen=True)
class Shape:
    """What an item is (words or bytes), how long windows and anchor runs are, and when an anchor is very frequent."""

    words: bool
    window: int
    gram: int
    hot: int = 20_000

    def blocks(self, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Row ranges worked on at a time, so that the numbers per item stay near 100 MB."""
        return arrays.blocks(offsets, arrays.BLOCK_BYTES if self.words else arrays.BLOCK_BYTES // 4)


class Items:
    """Items of a block of rows: hash, row, place in the row and byte bounds of each."""

    def __init__(self, shape: Shape, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        if shape.words:
            self.starts, self.ends, self.rows = arrays.words(data, offsets)
            self.hashes = arrays.span_hashes(data, self.starts, self.ends)
        else:
            self.starts = np.arange(len(data))
            self.ends = self.starts + 1
            self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            self.hashes = arrays._BYTE[data]
        self.first = np.searchsorted(self.rows, np.arange(len(offsets) - 1))

    def places(self, at: np.ndarray) -> np.ndarray:
        """Place of items inside their rows."""
        return at - self.first[self.rows[at]]

    def windows(self, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start item, anchor item, anchor hash) of every window inside one row, in pieces of bounded size."""
        step = max(PIECE, 2 * shape.window)
        for low in range(0, max(0, len(self.hashes) - shape.window + 1), step):
            part = self.hashes[low : low + step + shape.window - 1]
            runs = arrays.grams(part, shape.gram)
            packed = (runs & ~_PLACE) | np.arange(len(runs), dtype=np.uint64)
            least = arrays.minima(packed, shape.window - shape.gram + 1)
            start = np.arange(low, low + len(least))
            inside = self.rows[start] == self.rows[start + shape.window - 1]
            anchor = (least[inside] & _PLACE).astype(np.int64)
            yield start[inside], anchor + low, runs[anchor]


def pack(bucket: int, kind: int, data: bytes, ids, starts, counts, sizes) -> dict:
    """One packed row; ids are stored as differences from the smallest."""
    ids = np.asarray(ids, np.int64)
    base = int(ids.min()) if len(ids) else 0
    spread = ids - base
    narrow = len(ids) == 0 or int(spread.max()) < 1 << 31
    body = np.array([base], np.int64).tobytes() + spread.astype(np.int32 if narrow else np.int64).tobytes()
    return {
        "bucket": int(bucket), "kind": kind, "n": len(ids), "data": data, "ids": body,
        "starts": np.asarray(starts, np.int32).tobytes(), "counts": np.asarray(counts, np.int32).tobytes(),
        "sizes": np.asarray(sizes, np.int32).tobytes(),
    }


def unpack_ids(body: bytes, n: int) -> np.ndarray:
    """The ids of a packed row."""
    base = np.frombuffer(body, np.int64, 1)[0]
    return np.frombuffer(body, np.int32 if len(body) == 8 + 4 * n else np.int64, n, 8).astype(np.int64) + base


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in PACKED.split(", "))])


def _emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _schema())


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _scan(shape: Shape, buckets: int) -> Callable:
    """Anchors of all documents, packed by bucket."""

    def flush(found: list) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        hashes, ids, places = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(hashes, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = hashes[order][1:] != hashes[order][:-1]
        times = np.diff(np.concatenate([np.flatnonzero(first), [len(order)]]))
        once, again = order[first][times == 1], order[first][times > 1]
        rows = []
        of = np.zeros(len(order), np.int64)  # occurrences that the first one stands for
        of[order[first]] = times
        own = arrays.mix(ids.astype(np.uint64))
        for kind, some, key in ((0, np.sort(once), hashes), (2, np.sort(again), hashes), (1, np.sort(order[~first]), own)):
            for b, part in _by_bucket((key[some] % np.uint64(buckets)).astype(np.int64)):
                at = some[part]
                rows.append(pack(b, kind, hashes[at].tobytes(), ids[at], places[at], of[at], []))
        yield from _emit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = arrays.buffers(batch.column(1))
            for a, b in shape.blocks(offsets):
                items = Items(shape, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for _, anchor, hashes in items.windows(shape):
                    keep = np.ones(len(anchor), bool)
                    keep[1:] = anchor[1:] != anchor[:-1]
                    at = anchor[keep]
                    found.append((hashes[keep], ids[a + items.rows[at]], items.places(at)))
                    held += len(at)
                if held >= FLUSH:
                    yield from flush(found)
                    found, held = [], 0
        yield from flush(found)

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Occurrences in a bucket whose anchor occurs at least twice, with how often it occurs."""
    hashes, ids, places, kinds, times = [], [], [], [], []
    for row in table.select(["kind", "n", "data", "ids", "starts", "counts"]).to_pylist():
        hashes.append(np.frombuffer(row["data"], np.uint64))
        ids.append(unpack_ids(row["ids"], row["n"]))
        places.append(np.frombuffer(row["starts"], np.int32))
        kinds.append(np.full(row["n"], row["kind"], np.int8))
        times.append(np.frombuffer(row["counts"], np.int32))
    hashes, ids, places, kinds, times = (np.concatenate(x) for x in (hashes, ids, places, kinds, times))
    seen = np.zeros(len(hashes), np.int64)
    own = np.flatnonzero(kinds != 1)
    order = own[np.argsort(hashes[own], kind="stable")]
    if len(order):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(hashes[order])) + 1])
        total = np.add.reduceat(times[order].astype(np.int64), cut)
        seen[order] = np.repeat(total, np.diff(np.concatenate([cut, [len(order)]])))
    keep = (kinds > 0) | (seen > 1)
    return pa.table(
        {
            "doc_id": ids[keep], "place": places[keep].astype(np.int32),
            "hash": hashes[keep].astype(np.int64), "seen": seen[keep],
        }
    )


def recurring(docs: DataFrame, shape: Shape) -> DataFrame:
    """Stored table ``doc_id, place, hot`` of the anchors that occur more than once.

    Packed kinds: 0 only occurrence in its batch, 2 first of several in its batch, 1 later one.
    """
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    packed = rows.mapInArrow(_scan(shape, buckets), PACKED)
    found = packed.groupBy("bucket").applyInArrow(
        _repeats, "doc_id long, place int, hash long, seen long"
    )
    found = materialize(found, "anchors")
    hot = found.where(F.col("seen") > shape.hot).select("hash").distinct()
    if hot.isEmpty():
        return found.select("doc_id", "place", F.lit(False).alias("hot"))
    hot = hot.select("hash", F.lit(True).alias("hot"))
    return found.join(hot, "hash", "left").select("doc_id", "place", F.coalesce("hot", F.lit(False)).alias("hot"))


def _cut(shape: Shape, shards: int) -> Callable:
    """Segments of documents with recurring anchors, packed by shard; kinds: 0 segment, 1 known repeat, 2 its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = arrays.buffers(batch.column(1))
            lists = [[np.asarray(x, np.int64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            for a, b in shape.blocks(offsets):
                items = Items(shape, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                marks = np.zeros(len(items.hashes), np.int8)
                for value, places in ((1, lists[0]), (2, lists[1])):
                    for row in range(a, b):
                        if len(places[row]):
                            marks[items.first[row - a] + places[row]] = value
                for start, anchor, hashes in items.windows(shape):
                    held += _segments(found, shape, ids[a:b], items, marks, start, anchor, hashes)
                if held >= BODY_BYTES:
                    yield from _emit(_packed(found, shards))
                    found, held = [], 0
            yield from _emit(_packed(found, shards))
            found, held = [], 0

    return run


def _segments(found, shape, ids, items, marks, start, anchor, hashes) -> int:
    """Add the segments of a piece to ``found`` as ``Found``; returns their bytes."""
    sums = arrays.Sums(items.hashes)
    kept = np.flatnonzero(marks[anchor] == 1)
    start_c, anchor_c = start[kept], anchor[kept]
    new = np.ones(len(kept), bool)
    new[1:] = (anchor_c[1:] != anchor_c[:-1]) | (start_c[1:] != start_c[:-1] + 1)
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(kept)]]))
    size = _add(found, shape, ids, items, sums, start_c[first], counts, hashes[kept][first], 0)
    single = start[marks[anchor] == 2]
    if len(single):  # the first of equal windows is the one with the smallest (doc_id, start)
        single = single[np.lexsort((items.places(single), ids[items.rows[single]]))]
        run = sums.of(single, single + shape.window)
        _, at, group = np.unique(run, return_index=True, return_inverse=True)
        later = np.ones(len(single), bool)
        later[at] = False
        order = np.flatnonzero(later)
        w, lead, n = _equal_runs(shape, items, single[order], single[at[group[order]]])
        covered_by = np.repeat(w, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.ones(len(single), bool)  # sent: all but windows that were found equal to their first
        own[np.isin(single, covered_by)] = False
        twice = np.isin(single, np.repeat(lead, n) + covered_by - np.repeat(w, n))
        for kind, some in ((0, own & ~twice), (2, own & twice)):
            ones = np.ones(int(some.sum()), np.int64)
            size += _add(found, shape, ids, items, sums, single[some], ones, run[some], kind)
        known = arrays.mix(ids[items.rows[w]].astype(np.uint64) + items.places(w).astype(np.uint64))
        found.append(Found(1, known, ids[items.rows[w]], items.places(w), n))
    return size


def _equal_runs(shape: Shape, items: Items, later: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first window, first window of the leaders, number) of windows ``later`` whose items equal those of ``lead``.

    Neighbours with neighbouring leaders are compared as one stretch of text; where its bytes differ,
    window by window, as sequences of items.
    """
    order = np.argsort(later, kind="stable")
    w, x = later[order], lead[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1] + 1) | (x[1:] != x[:-1] + 1) | (items.rows[w[1:]] != items.rows[w[:-1]]) | (items.rows[x[1:]] != items.rows[x[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(w)]]))
    raw = memoryview(items.data)
    out = []
    for a, b, count in zip(w[first].tolist(), x[first].tolist(), n.tolist(), strict=True):
        if _text(raw, items, a, count, shape) == _text(raw, items, b, count, shape):
            out.append((a, b, count))
        elif shape.words:
            out += [(a + k, b + k, 1) for k in range(count) if _text(raw, items, a + k, 1, shape).tobytes().split() == _text(raw, items, b + k, 1, shape).tobytes().split()]
    return tuple(np.array([r[k] for r in out], np.int64) for k in range(3))


def _text(raw: memoryview, items: Items, start: int, count: int, shape: Shape) -> memoryview:
    return raw[items.starts[start] : items.ends[start + count + shape.window - 2]]


@dataclass
class Found:
    """Segments of a piece: kind, key, document, place, number of windows; for those that carry text its hash,
    its bounds and the bytes these refer to."""

    kind: int
    keys: np.ndarray
    ids: np.ndarray
    places: np.ndarray
    counts: np.ndarray
    signs: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    data: np.ndarray | None = None


def _add(found, shape, ids, items, sums, start, counts, keys, kind) -> int:
    if not len(start):
        return 0
    low, high = items.starts[start], items.ends[start + counts + shape.window - 2]
    signs = arrays.mix(sums.of(start, start + counts + shape.window - 1) ^ counts.astype(np.uint64))
    found.append(Found(kind, keys, ids[items.rows[start]], items.places(start), counts, signs, low, high, items.data))
    return int((high - low).sum())


def _once(found: list[Found]) -> tuple[list[Found], list[memoryview], np.ndarray]:
    """Of segments with equal bytes the one with the smallest (doc_id, start) as kind 2, the others as known
    repeats. Also the pieces of text, and for the segments of each result in turn the number of its piece.

    Only segments with equal hash and length are compared, each with the first of them.
    """
    parts = [x for x in found if x.kind != 1]
    out = [x for x in found if x.kind == 1]
    if not parts:
        return out, [], np.zeros(0, np.int64)
    raws = [memoryview(x.data) for x in parts]
    piece = np.repeat(np.arange(len(parts)), [len(x.keys) for x in parts])
    kinds = np.array([x.kind for x in parts])[piece]
    keys, ids, places, counts, signs, low, high = (
        np.concatenate([getattr(x, c) for x in parts]) for c in ("keys", "ids", "places", "counts", "signs", "low", "high")
    )
    order = np.lexsort((places, ids, high - low, signs))
    lead = np.ones(len(order), bool)
    lead[1:] = (signs[order[1:]] != signs[order[:-1]]) | ((high - low)[order[1:]] != (high - low)[order[:-1]])
    leader = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    repeat, several = np.zeros(len(order), bool), kinds == 2
    for a, b in zip(order[~lead].tolist(), leader[~lead].tolist(), strict=True):
        if raws[piece[a]][low[a] : high[a]] == raws[piece[b]][low[b] : high[b]]:
            repeat[a] = several[b] = True
    pieces = []
    for kind, at in ((0, np.flatnonzero(~several & ~repeat)), (2, np.flatnonzero(several & ~repeat))):
        out.append(Found(kind, keys[at], ids[at], places[at], counts[at], None, low[at], high[at]))
        pieces.append(piece[at])
    at = np.flatnonzero(repeat)
    out.append(Found(1, arrays.mix(ids[at].astype(np.uint64) + places[at].astype(np.uint64)), ids[at], places[at], counts[at]))
    return out, raws, np.concatenate(pieces)


def _packed(found: list[Found], shards: int) -> list[dict]:
    """The segments found, one row per shard and kind; equal ones once."""
    rows = []
    found, raws, piece = _once(found)
    for kind in (0, 1, 2):
        parts = [x for x in found if x.kind == kind and len(x.keys)]
        if not parts:
            continue
        keys, ids, places, counts = (np.concatenate([getattr(x, c) for x in parts]) for c in ("keys", "ids", "places", "counts"))
        if kind != 1:
            (part,) = parts
            mine = piece[: len(keys)] if kind == 0 else piece[-len(keys) :]
        for b, at in _by_bucket((arrays.mix(keys) % np.uint64(shards)).astype(np.int64)):
            body, sizes = b"", np.zeros(len(at))
            if kind != 1:
                bounds = zip(mine[at].tolist(), part.low[at].tolist(), part.high[at].tolist(), strict=True)
                body, sizes = b"".join([raws[k][x:y] for k, x, y in bounds]), part.high[at] - part.low[at]
            rows.append(pack(b, kind, body, ids[at], places[at], counts[at], sizes))
    return rows


@dataclass
class Shard:
    """Segments that met in one shard, in (doc_id, start) order: text pieces, first window and number of windows."""

    data: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    repeated: np.ndarray  # the same window occurs again in the segment's own block


def _load(table: pa.Table) -> tuple[Shard, list]:
    """The segments of a shard, and the (id, start, count) arrays of known repeats."""
    parts, known = [], []
    for row in table.to_pylist():
        ids = unpack_ids(row["ids"], row["n"])
        starts, counts = (np.frombuffer(row[k], np.int32) for k in ("starts", "counts"))
        if row["kind"] == 1:
            known.append((ids, starts, counts))
            continue
        sizes = np.frombuffer(row["sizes"], np.int32)
        parts.append((np.frombuffer(row["data"], np.uint8), ids, starts, counts, sizes, np.full(row["n"], row["kind"] == 2)))
    if not parts:
        none = np.zeros(0, np.int64)
        return Shard(np.zeros(0, np.uint8), np.zeros(1, np.int64), none, none, none, none.astype(bool)), known
    data, ids, starts, counts, sizes, repeated = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.cumsum(sizes.astype(np.int64))
    order = np.lexsort((starts, ids))
    sizes_o = sizes[order].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes_o)])
    index = np.arange(offsets[-1]) + np.repeat(ends[order] - sizes_o - offsets[:-1], sizes_o)
    return Shard(data[index], offsets, ids[order], starts[order], counts[order], repeated[order]), known


def repeated_windows(
    docs: DataFrame, anchors: DataFrame, shape: Shape, find: Callable[[Shard], tuple], per_shard: int
) -> DataFrame:
    """``doc_id, runs``: per document the runs (first window, number of windows) that ``find`` reports.

    ``find`` gets a shard and returns arrays (segment number, first window inside the segment,
    number of windows); known repeats are passed on as they are.
    """
    shards = max(1, anchors.count() // per_shard + 1)
    per_doc = anchors.groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("place"))).alias("cold"),
        F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot"),
    )
    rows = docs.join(per_doc, "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), "cold", "hot")
    packed = rows.mapInArrow(_cut(shape, shards), PACKED)

    def run(table: pa.Table) -> pa.Table:
        shard, known = _load(table)
        segment, first, n = find(shard)
        parts = [(shard.ids[segment], shard.starts[segment] + first, n), *known]
        ids, starts, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"doc_id": ids.astype(np.int64), "start": starts.astype(np.int32), "n": counts.astype(np.int32)})

    runs = packed.groupBy("bucket").applyInArrow(run, "doc_id long, start int, n int")
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def covered(runs: list[dict] | None, window: int, size: int) -> np.ndarray:
    """Mask of the items that windows of the runs cover."""
    change = np.zeros(size + 1, np.int32)
    for run in runs or []:
        change[run["start"]] += 1
        change[run["start"] + run["n"] + window - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def consecutive(flags: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs of true flags, cut where the group changes."""
    at = np.flatnonzero(flags)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (groups[at[1:]] != groups[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.concatenate([first, [len(at)]]))

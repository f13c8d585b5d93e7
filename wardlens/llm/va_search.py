"""Exact top-k search by inner product over a vector-approximation file.

Components become ``floor(256 * x)``; scores are integers. Each vector has a cell: one of 16 intervals per
component, in a grid of its block's mean and spread. The cell's centre and the distance to it bound the score:
|q.x - q.m| <= |q| |x - m|.

1. Equal vectors form a class with its k + 1 smallest ids (more can never be needed), so a vector that a third of
   all rows hold is searched once and found once.
2. Classes are packed into blocks of BLOCK vectors: grid, cells of half a byte, distances, and apart from
   these the exact vectors and ids. The blocks are written: that is the approximation file.
3. Distinct query vectors form groups of bounded size. Every group meets every slice of the blocks (queries
   against all rows, in blocks); rows are dealt and sorted so that a task streams blocks past one group.
4. In a block, cells give bounds for all its vectors; what lies below the k-th lower bound or the k-th
   score so far is out. The rest are read exactly in the order of their bounds, highest first, until
   no bound reaches the k-th score.
5. The best of each slice are merged, and each query row takes its class's list without itself.

Ties go to the smaller id. Only vectors of equal length are compared. Vectors that are null or hold nulls or
non-finite components (after scaling) take no part, nor do rows without id. Rows that share an id count
once, with the greatest of their code strings. A query with fewer other rows gets fewer; an empty table gives no
rows. Scores beyond a long are clamped to it. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm import arrays
from wardlens.llm.tables import materialize

BLOCK = 1024
GROUP_BYTES = 32 << 20  # of query vectors in one task, as float32
TILE = 2048  # queries bounded at a time
READ = 8  # vectors a query reads exactly at first; doubled each round
CELLS = 16
_NONE = np.iinfo(np.int64).max
_LEAST = -_NONE

_KEY = ["dim", "width", "codes"]
_ENCODED = "vec_id long, dim int, width int, codes binary"
_BLOCKS = "dim int, part int, n int, width int, grid binary, cells binary, slack binary, exact binary, ids binary"
_CELL = f"dim int, query_group int, slice int, width int, codes binary, {_BLOCKS.split(', ', 2)[2].replace('width', 'wide')}"
_FOUND = "dim int, width int, codes binary, score array<long>, vec_id array<long>"

# Interval borders and centres (means of the intervals) of a standard normal in CELLS equal shares.
_NORMAL = NormalDist()
_BORDERS = np.array([_NORMAL.inv_cdf(j / CELLS) for j in range(1, CELLS)])
_DENSITY = np.array([0.0, *(_NORMAL.pdf(b) for b in _BORDERS), 0.0])
_CENTRES = ((_DENSITY[:-1] - _DENSITY[1:]) * CELLS).astype(np.float32)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _ENCODED; 2 bytes a component where all fit, else 8 (doubles)."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("embedding")
        start = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(256 * values)
        size = np.diff(start)
        present = lists.is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(size[present]):
            rows = np.flatnonzero(present & (size == dim))
            x = values[start[rows][:, None] + np.arange(dim)]
            fine = np.isfinite(x).all(axis=1)
            rows, x = rows[fine], x[fine] + 0.0  # no negative zero
            small = (np.abs(x) <= 32767).all(axis=1)
            for width, kind, mine in ((2, "<i2", small), (8, "<f8", ~small)):
                raw, n = x[mine].astype(kind).tobytes(), int(mine.sum())
                step = int(dim) * width
                codes = [raw[k * step : (k + 1) * step] for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows[mine]], pa.int64()), pa.array([dim] * n, pa.int32()), pa.array([width] * n, pa.int32()), pa.array(codes, pa.binary())],
                    names=["vec_id", *_KEY],
                )


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, dim, width, codes`` of the vectors that take part, one row per id, written once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    coded = materialize(rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_encode, _ENCODED), "codes")
    twice = coded.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if not twice.isEmpty():
        best = F.max(F.struct(*_KEY)).alias("_best")
        again = coded.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(best).select("vec_id", "_best.*")
        coded = materialize(coded.join(twice, "vec_id", "left_anti").unionByName(again), "codes")
    return coded


def _numbers(width: int, raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if width == 2 else "<f8").reshape(n, dim)


def _block(dim: int, part: int, rows: list[tuple[int, bytes, list[int]]], keep: int) -> tuple:
    """A row of _BLOCKS from ``width, codes, ids`` of up to BLOCK vectors."""
    n = len(rows)
    width = max(w for w, _, _ in rows)
    x = np.stack([_numbers(w, c, dim, 1)[0].astype(np.float64) for w, c, _ in rows])
    with np.errstate(over="ignore", invalid="ignore"):
        grid = np.nan_to_num(np.stack([x.mean(axis=0), x.std(axis=0)]) if dim else np.zeros((2, 0))).astype(np.float32 if width == 2 else np.float64)
        borders = grid[0] + grid[1] * _BORDERS[:, None]
        cells = np.zeros((n, dim), np.uint8)
        for row in borders:
            cells += x >= row
        centre = (grid[0] + grid[1] * _CENTRES[cells]).astype(grid.dtype)
        away = np.sqrt(((x - centre) ** 2).sum(axis=1))
        size = np.sqrt((centre.astype(np.float64) ** 2).sum(axis=1))
        # distance, and what rounding of the product with the centre can add
        slack = away * 1.00001 + (size + away) * (1e-6 + 2.5e-7 * dim)
    slack = np.nan_to_num(slack, nan=np.inf).astype(np.float32 if width == 2 else np.float64)
    if dim % 2:
        cells = np.concatenate([cells, np.zeros((n, 1), np.uint8)], axis=1)
    ids = np.full((n, keep), _NONE)
    for k, (_, _, mine) in enumerate(rows):
        ids[k, : len(mine)] = mine
    exact = x.astype("<i2" if width == 2 else "<f8")
    return dim, part, n, width, grid.tobytes(), (cells[:, ::2] | cells[:, 1::2] << 4).tobytes(), slack.tobytes(), exact.tobytes(), ids.tobytes()


_TYPES = {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields]
    )


def _pack(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    part, waiting = TaskContext.get().partitionId(), {}
    for batch in batches:
        for dim, width, codes, ids in zip(*[batch.column(c).to_pylist() for c in (*_KEY, "ids")]):
            mine = waiting.setdefault(dim, [])
            mine.append((width, codes, ids))
            if len(mine) == BLOCK:
                yield _batch([_block(dim, part, waiting.pop(dim), keep)], _BLOCKS)
                part += 1
    for dim, mine in waiting.items():
        yield _batch([_block(dim, part, mine, keep)], _BLOCKS)
        part += 1


def approximation_file(coded: DataFrame, keep: int) -> DataFrame:
    """Blocks of all distinct vectors with their ``keep`` smallest ids, written. ``part`` spreads them evenly."""
    first = Window.partitionBy(*_KEY).orderBy("vec_id")
    few = coded.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= keep)
    classes = few.groupBy(*_KEY).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return materialize(classes.mapInArrow(lambda b: _pack(b, keep), _BLOCKS), "approximations")


class _Group:
    """Distinct queries of one group with the best ``keep`` classes so far."""

    def __init__(self, dim: int, keep: int):
        self.dim, self.keep = dim, keep
        self.widths, self.codes = [], []

    def close(self) -> None:
        """All queries are in."""
        n = len(self.codes)
        wide = max(self.widths, default=2)
        if wide == min(self.widths, default=2):
            self.exact = _numbers(wide, b"".join(self.codes), self.dim, n)
        else:
            self.exact = np.stack([_numbers(w, c, self.dim, 1)[0].astype("<f8") for w, c in zip(self.widths, self.codes)])
        self.wide = wide > 2
        self.near = self.exact.astype(np.float64 if self.wide else np.float32)
        with np.errstate(over="ignore"):
            self.length = np.concatenate([np.sqrt((self.exact[k : k + TILE].astype(np.float64) ** 2).sum(axis=1)) for k in range(0, n, TILE)] or [np.zeros(0)])
        self.length = self.length * 1.000001
        self.top = float(np.abs(self.exact).max(initial=0))
        self.score = np.full((n, self.keep), _LEAST)
        self.ids = np.full((n, self.keep, self.keep), _NONE)

    def limit(self, rows: np.ndarray | slice) -> np.ndarray:
        """A bound at or above this may still count; -inf while fewer than ``keep`` classes are known."""
        last = self.score[rows, -1].astype(np.float64)
        return np.where(self.ids[rows, -1, 0] == _NONE, -np.inf, np.nextafter(last, -np.inf))

    def meet(self, n: int, width: int, grid: bytes, cells: bytes, slack: bytes, exact: bytes, ids: bytes) -> None:
        """Compare all queries with a block."""
        kind = np.float32 if width == 2 else np.float64
        mean, spread = np.frombuffer(grid, kind).reshape(2, self.dim)
        half = np.frombuffer(cells, np.uint8).reshape(n, (self.dim + 1) // 2)
        cell = np.stack([half & 15, half >> 4], axis=2).reshape(n, -1)[:, : self.dim]
        centre = (mean + spread * _CENTRES[cell]).astype(kind)
        slack = np.frombuffer(slack, kind)
        read = _numbers(width, exact, self.dim, n)  # a view; only rows that bounds let through are touched
        ids = np.frombuffer(ids, np.int64).reshape(n, self.keep)
        # Sums of products stay below 2**53: exact as doubles.
        exactly = _product if self.dim * self.top * float(np.abs(read).max(initial=0)) < 2.0**53 else _long_product
        for first in range(0, len(self.codes), TILE):
            rows = slice(first, first + TILE)
            with np.errstate(over="ignore", invalid="ignore"):
                middle = self.near[rows] @ centre.T
                reach = self.length[rows, None].astype(middle.dtype) * slack
                limit = self.limit(rows)
                if n >= self.keep and not np.isfinite(limit).all():
                    low = np.nan_to_num(np.partition(middle - reach, n - self.keep, axis=1)[:, n - self.keep].astype(np.float64), nan=-np.inf)
                    limit = np.maximum(limit, np.nextafter(low, -np.inf))
                upper = middle + reach
                # float32 borders are moved down, so none that counts is lost
                border = limit.astype(upper.dtype) if upper.dtype == np.float64 else np.nextafter(limit.astype(np.float32), np.float32(-np.inf))
                q, x = np.nonzero(~(upper < border[:, None]))
            if len(q):
                self._read(q + first, x, upper[q, x].astype(np.float64), read, ids, exactly)

    def _read(self, q: np.ndarray, x: np.ndarray, bound: np.ndarray, read: np.ndarray, ids: np.ndarray, exactly) -> None:
        """Exact scores in the order of the bounds until no bound reaches a query's last place."""
        order = np.lexsort((-bound, q))
        q, x, bound = q[order], x[order], bound[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        low, step = 0, READ
        while len(q):
            now = nth < low + step
            for k in range(0, int(now.sum()), 1 << 16):
                at = np.flatnonzero(now)[k : k + (1 << 16)]
                self._keep(q[at], exactly(self.exact[q[at]], read[x[at]]), ids[x[at]])
            low, step = low + step, step * 2
            rest = ~now
            q, x, bound, nth = q[rest], x[rest], bound[rest], nth[rest]
            alive = ~(bound * (1 + 1e-6 * np.sign(bound)) + 1 < self.limit(q))
            q, x, bound, nth = q[alive], x[alive], bound[alive], nth[alive]

    def _keep(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge new classes into the best of their queries: higher score, then smaller id."""
        touched = np.unique(q)
        who = np.concatenate([np.repeat(touched, self.keep), q])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.ids[touched].reshape(-1, self.keep), ids])
        order = np.lexsort((ids[:, 0], ~score, who))
        who, nth = who[order], np.arange(len(order)) - np.searchsorted(who[order], who[order])
        first = nth < self.keep
        self.score[who[first], nth[first]] = score[order[first]]
        self.ids[who[first], nth[first]] = ids[order[first]]

    def found(self) -> Iterator[pa.RecordBatch]:
        """Rows of _FOUND: the best ``keep`` ids of each query."""
        for first in range(0, len(self.codes), TILE):
            rows = slice(first, first + TILE)
            ids = self.ids[rows].reshape(-1, self.keep**2)
            score = np.repeat(self.score[rows], self.keep, axis=1)
            out = []
            for k in range(len(ids)):
                real = np.flatnonzero(ids[k] != _NONE)
                if len(real):
                    best = real[np.lexsort((ids[k, real], ~score[k, real]))][: self.keep]
                    out.append((self.dim, self.widths[first + k], self.codes[first + k], score[k, best], ids[k, best]))
            if out:
                yield _batch(out, _FOUND)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)


def _long_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sums = [sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a.tolist(), b.tolist())]
    return np.array([min(max(v, _LEAST), _NONE) for v in sums], np.int64)


def _search(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Groups of queries, each followed by the blocks of a slice."""
    cell, group, open_ = None, None, False
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            dim, number, at, width, codes, n, *block = row
            if (dim, number, at) != cell:
                if group is not None:
                    if open_:
                        group.close()
                    yield from group.found()
                cell, group, open_ = (dim, number, at), _Group(dim, keep), True
            if n is None:
                group.widths.append(width)
                group.codes.append(codes)
                continue
            if open_:
                group.close()
                open_ = False
            group.meet(n, *block)
    if group is not None:
        if open_:
            group.close()
        yield from group.found()


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` other rows with the highest scores for each query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark, keep = vectors.sparkSession, k + 1
    coded = encode(vectors, id_col, vector_col)
    blocks = approximation_file(coded, keep)
    asked = coded.where(is_query)
    queries = materialize(asked.select(*_KEY).distinct(), "queries")
    count, dim = queries.agg(F.count("*"), F.max("dim")).first()
    total = blocks.agg(F.sum("n")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-count // max(1, GROUP_BYTES // (4 * max(dim or 1, 1)))))
    slices = max(1, min(-(-parts // groups), -(-total // BLOCK)))

    none = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split(" ") for f in _CELL.split(", ")[5:])]
    group = F.pmod(F.xxhash64(*_KEY), F.lit(groups)).cast("int").alias("query_group")
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    left = queries.select("dim", group, every, "width", "codes", *none)
    all_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("query_group")
    slice_ = F.pmod(F.col("part"), F.lit(slices)).cast("int").alias("slice")
    block = ["n", F.col("width").alias("wide"), "grid", "cells", "slack", "exact", "ids"]
    right = blocks.select("dim", all_groups, slice_, F.lit(None).cast("int").alias("width"), F.lit(None).cast("binary").alias("codes"), *block)
    place = F.pmod(F.xxhash64("dim") + F.col("query_group") * slices + F.col("slice"), F.lit(parts)).cast("int")
    cells = left.unionByName(right).withColumn("_place", place).repartitionById(parts, F.col("_place")).drop("_place")
    cells = cells.sortWithinPartitions("dim", "query_group", "slice", F.col("n").asc_nulls_first())
    found = cells.mapInArrow(lambda b: _search(b, keep), _FOUND)

    # At most `slices` lists of `keep` rows for each distinct query.
    pairs = F.transform(F.arrays_zip("score", "vec_id"), lambda p: F.struct((-p["score"]).alias("less"), p["vec_id"].alias("vec_id")))
    merged = F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, keep).alias("best")
    best = found.groupBy(*_KEY).agg(merged)
    others = F.slice(F.filter("best", lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    lists = asked.withColumnRenamed("vec_id", "query_id").join(best, _KEY).select("query_id", F.posexplode(others).alias("_nth", "_hit"))
    return lists.select("query_id", (F.col("_nth") + 1).alias("rank"), F.col("_hit.vec_id").alias("vec_id"), (-F.col("_hit.less")).alias("score"))

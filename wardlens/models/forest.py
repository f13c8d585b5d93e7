"""Random forests whose trees are finished in tasks of bounded size.

Features are cut at quantiles into at most 255 bins and the binned rows are written once. How often a tree draws a row
(Poisson with mean 1) and which features a node may use follow from hashes of row, tree and node, so every task can work
them out for itself.

1. Tops. Nodes that hold more than ``LOCAL_ROWS`` rows are split by passes over the table, a level of all trees at a time:
   tasks add up sums per (tree, node, feature, bin), a shuffle by (tree, node) finds the splits, and only these reach the driver.
2. Rests. Each row goes to the nodes below the tops that drew it, one node to a task, which grows all that is below it.
   Two-valued features of which no row has two at the higher bin share a column there and take one pass over the rows.
3. The nodes are written in the form in which Spark ML stores forests. They stay there: no model lies in the driver.
4. Prediction. Rows are binned by the same cuts and packed in blocks; each group of trees meets all blocks in tasks that hold
   the nodes of their group only, and the votes of all groups are added up by block.

The same forest comes out for any ``LOCAL_ROWS``.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.models.bins import MISSING, quantile_cuts, to_bins
from wardlens.sources.scratch import materialize, scratch_path

LOCAL_ROWS = 1 << 17
ROW_ID = "facility_id"  # rows with this column are drawn by it, hence alike on any partitioning; others by their place
TASKS = 2_000  # at most this many tasks grow the rests; each works off its nodes one after another
GROUPS = 48  # groups of trees that predict apart, at least (if there are as many trees)
GROUP_NODES = 1 << 21  # nodes of a group, at most (if a tree has fewer)
PART_ROWS = 1 << 21  # rows that a task predicts
BLOCK = 1 << 13
LEVELS = 3  # levels that rows go down before those at leaves are left out
SHARED = 31  # features that share a column, at most
_VOTES = "first long, group int, votes binary"
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_NODES = "slot long, id long, feature int, threshold double, gain double, left_id long, sums array<double>"


@dataclass(frozen=True)
class Rules:
    """Rules of growth. ``classes`` is 0 in regression; ``subset`` features are tried in a node, 0 for all."""

    trees: int = 300
    max_depth: int = 30
    min_leaf: int = 5
    subset: int = 0
    classes: int = 0
    seed: int = 42


@dataclass
class Top:
    """Upper part of a tree as lists; ``left`` is -1 where it ends. The right child follows the left one."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    left: list[int] = field(default_factory=lambda: [-1])
    sums: list[list[float]] = field(default_factory=lambda: [[]])
    path: list[int] = field(default_factory=lambda: [1])  # 2 p and 2 p + 1 below p

    def split(self, node: int, feature: int, cut: int, gain: float, sums: list[float]) -> list[int]:
        child = len(self.left)
        self.feature[node], self.cut[node], self.gain[node], self.left[node], self.sums[node] = feature, cut, gain, child, sums
        for k in (0, 1):
            self.feature.append(-1)
            self.cut.append(0)
            self.gain.append(-1.0)
            self.left.append(-1)
            self.sums.append([])
            self.path.append(2 * self.path[node] + k)
        return [child, child + 1]

    def ends(self, bins: np.ndarray) -> np.ndarray:
        """End of every binned row."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node = np.zeros(len(bins), np.int64)
        rows = np.flatnonzero(left[node] >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = left[at] + (bins[rows, feature[at]] > cut[at])
            rows = rows[left[node[rows]] >= 0]
        return node


def _mix(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of every number (the finisher of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salt(tree: int, rules: Rules, use: int) -> np.ndarray:
    return _mix(_mix(np.array([rules.seed * 2 + use])) ^ np.array([tree], np.uint64))


def drawn(ids: np.ndarray, tree: int, rules: Rules) -> np.ndarray:
    """How often a tree draws each row."""
    shares = (_mix(ids.astype(np.uint64) ^ _salt(tree, rules, 0)) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_POISSON, shares, "right").astype(np.uint8)


def allowed(path: np.ndarray, tree: int, width: int, rules: Rules) -> np.ndarray | None:
    """Which features each node may use (node, feature); None for all."""
    if not 0 < rules.subset < width:
        return None
    own = _mix(path.astype(np.uint64) ^ _salt(tree, rules, 1))
    order = np.argsort(_mix(own[:, None] + np.arange(width, dtype=np.uint64)), axis=1)
    out = np.zeros((len(path), width), bool)
    np.put_along_axis(out, order[:, : rules.subset], True, axis=1)
    return out


def _stats(times: np.ndarray, label: np.ndarray, weight: np.ndarray, rules: Rules) -> np.ndarray:
    """(sum, row): rows drawn, then weight by class or, in regression, label and its square."""
    n = times.astype(float)
    if rules.classes:
        return np.stack([n, *[n * weight * (label == k) for k in range(rules.classes)]])
    return np.stack([n, n * label, n * label**2])


def _score(sums: np.ndarray, rules: Rules) -> np.ndarray:
    """Sum of squared class weights over the weight, or squared label sum over the rows."""
    if not rules.classes:
        return sums[1] ** 2 / np.maximum(sums[0], 1e-300)
    return (sums[1:] ** 2).sum(axis=0) / np.maximum(sums[1:].sum(axis=0), 1e-300)


def _weight(sums: np.ndarray, rules: Rules) -> np.ndarray:
    return sums[1:].sum(axis=0) if rules.classes else sums[0]


def _gains(below: np.ndarray, total: np.ndarray, rules: Rules) -> np.ndarray:
    """Impurity lost by each cut per unit of weight, to nine places; 0 where a child would be too small."""
    above = total - below
    gain = (_score(below, rules) + _score(above, rules) - _score(total, rules)) / np.maximum(_weight(total, rules), 1e-300)
    fits = (np.round(below[0]) >= rules.min_leaf) & (np.round(above[0]) >= rules.min_leaf)
    return np.where(fits, np.round(gain, 9), 0.0)


def _cells(bins: np.ndarray, slot: np.ndarray, stats: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Sums by (sum, node, bin) of one feature."""
    key = slot * width + bins
    return np.stack([np.bincount(key, s, nodes * width) for s in stats]).reshape(len(stats), nodes, width)


def _best_cut(bins: np.ndarray, slot: np.ndarray, stats: np.ndarray, total: np.ndarray, width: int, rules: Rules):
    """(gain, cut) of one feature for each node that has rows: (nodes, gains, cuts)."""
    nodes = total.shape[1]
    if nodes * width <= 8 * len(slot) + 1024:
        below = np.cumsum(_cells(bins, slot, stats, nodes, width), axis=2)[:, :, :-1]
        gain = _gains(below, total[:, :, None], rules)
        cut = gain.argmax(axis=1)
        return np.arange(nodes), gain[np.arange(nodes), cut], cut
    # Few rows a node: only the bins that occur.
    key = slot * width + bins
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    node, bin_ = key[first] // width, key[first] % width
    sums = np.add.reduceat(stats[:, order], first, axis=1)
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    below = np.cumsum(sums, axis=1)
    lengths = np.diff(starts, append=len(node))
    below -= np.repeat(below[:, starts] - sums[:, starts], lengths, axis=1)
    gain = _gains(below, total[:, node], rules)
    gain[np.append(starts[1:], len(node)) - 1] = 0.0  # nothing is above the last bin
    top = np.maximum.reduceat(gain, starts)
    hits = np.flatnonzero(gain == np.repeat(top, lengths))
    _, at = np.unique(node[hits], return_index=True)  # the lowest of equal cuts
    return node[starts], top, bin_[hits[at]]


@dataclass(frozen=True)
class Columns:
    """Binned features in fewer columns, (column, row).

    Two-valued features of which no row has two at the higher bin, such as the levels of a category, share a column: it holds
    the ``code`` of the feature that is high, or 0. Every other column has the bins of one feature, whose code is 0. Features
    with one bin have no column.
    """

    values: np.ndarray
    members: list[list[int]]  # features of each column
    column: np.ndarray  # of each feature
    code: np.ndarray
    low: np.ndarray  # lower bin of each feature


def share_columns(bins: np.ndarray) -> Columns:
    """Columns of binned features (feature, row)."""
    low, high = bins.min(axis=1), bins.max(axis=1)
    values, members, column, code = [], [], np.full(len(bins), -1), np.zeros(len(bins), np.int64)
    shared: list[int] = []
    for f, mine in enumerate(bins):
        up = mine == high[f]
        if low[f] == high[f]:
            continue
        if not (up | (mine == low[f])).all():
            column[f] = len(values)
            values.append(mine)
            members.append([f])
            continue
        rows = np.flatnonzero(up)
        free = (c for c in shared if len(members[c]) < SHARED and not values[c][rows[:64]].any() and not values[c][rows].any())
        at = next(free, None)
        if at is None:
            at = len(values)
            shared.append(at)
            values.append(np.zeros(bins.shape[1], np.uint8))
            members.append([])
        members[at].append(f)
        column[f], code[f] = at, len(members[at])
        values[at][rows] = code[f]
    kept = np.stack(values) if values else np.zeros((0, bins.shape[1]), np.uint8)
    return Columns(kept, members, column, code, low.astype(np.int64))


def _best_shared(codes: np.ndarray, slot: np.ndarray, stats: np.ndarray, total: np.ndarray, features: np.ndarray, may: np.ndarray | None, rules: Rules):
    """(gain, feature) of the best of the features that share a column, for each node."""
    above = _cells(codes, slot, stats, total.shape[1], len(features) + 1)[:, :, 1:]
    gain = _gains(total[:, :, None] - above, total[:, :, None], rules)
    if may is not None:
        gain = np.where(may[:, features], gain, 0.0)
    top = gain.argmax(axis=1)
    return gain[np.arange(len(top)), top], features[top]


def best_splits(values: np.ndarray, columns: Columns, slot: np.ndarray, stats: np.ndarray, total: np.ndarray, may: np.ndarray | None, widths: list[int], rules: Rules):
    """(gain, feature, cut) for each node; gain 0 if it has no split. Ties go to the lower feature, then the lower cut.

    ``values`` are the columns of the rows at hand.
    """
    nodes = total.shape[1]
    gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
    if not rules.classes:
        stats, total = stats[:2], total[:2]  # gains need no squares
    for mine, members in zip(values, columns.members):
        f, s, x = members[0], slot, stats
        if columns.code[f]:
            g, of = _best_shared(mine, s, x, total, np.array(members), may, rules)
            better = (g > gain) | ((g == gain) & (g > 0) & (of < feature))
            gain[better], feature[better], cut[better] = g[better], of[better], columns.low[of[better]]
            continue
        width = widths[f]
        if may is not None:
            rows = np.flatnonzero(may[slot, f])
            if not len(rows):
                continue
            mine, s, x = mine[rows], slot[rows], stats.take(rows, 1)
        at, g, c = _best_cut(mine, s, x, total, width, rules)
        better = (g > gain[at]) | ((g == gain[at]) & (g > 0) & (f < feature[at]))
        if may is not None:
            better &= may[at, f]
        at = at[better]
        gain[at], feature[at], cut[at] = g[better], f, c[better]
    return gain, feature, cut


def grow(bins: np.ndarray, stats: np.ndarray, tree: int, path: int, cuts: list[np.ndarray], rules: Rules) -> dict[str, np.ndarray]:
    """All nodes from ``path`` down, level by level; ``bins`` is (feature, row)."""
    widths, columns = [len(c) + 2 for c in cuts], share_columns(bins)
    values, slot, paths, first, levels = columns.values, np.zeros(bins.shape[1], np.int64), np.array([path]), 0, []
    while len(paths):
        nodes = len(paths)
        total = np.stack([np.bincount(slot, s, nodes) for s in stats])
        gain, feature, cut = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        open_ = np.full(nodes, int(paths[0]).bit_length() <= rules.max_depth) & (total[0] >= 2 * rules.min_leaf)
        if open_.any():
            rows, rank = np.flatnonzero(open_[slot]), np.cumsum(open_) - 1
            values, stats, slot = values.take(rows, 1), stats.take(rows, 1), slot[rows]
            may = allowed(paths[open_], tree, len(cuts), rules)
            gain[open_], feature[open_], cut[open_] = best_splits(values, columns, rank[slot], stats, total[:, open_], may, widths, rules)
        split = gain > 0
        rank = np.cumsum(split) - 1
        threshold = np.array([cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(feature[split], cut[split])])
        level = {"feature": np.where(split, feature, -1), "threshold": np.zeros(nodes), "gain": np.where(split, gain, -1.0)}
        level["threshold"][split] = threshold
        level["left_id"] = np.where(split, first + nodes + 2 * rank, -1)
        level["sums"] = total.T
        levels.append(level)
        rows = np.flatnonzero(split[slot]) if split.any() else np.zeros(0, np.int64)
        values, stats, slot = values.take(rows, 1), stats.take(rows, 1), slot[rows]
        of = feature[slot]
        mine, code = values[columns.column[of], np.arange(len(rows))], columns.code[of]
        slot = 2 * rank[slot] + np.where(code > 0, mine == code, mine > cut[slot])
        paths = np.stack([2 * paths[split], 2 * paths[split] + 1], axis=1).ravel()
        first += nodes
    return {c: np.concatenate([level[c] for level in levels]) for c in levels[0]}


def _batch_arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """id, label, weight and bins (row, feature) of a batch of the stored table."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return (*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "weight")], bins)


def _level_sums(batches: Iterator[pa.RecordBatch], tops: dict[int, Top], wanted: dict[int, list[int]], widths: list[int], rules: Rules):
    """Sums of the wanted nodes over a task's rows: ``tree, node, sums`` (sum, cell), features end to end."""
    total: dict[int, np.ndarray] = {}
    rows = 3 if not rules.classes else 1 + rules.classes
    ends = np.cumsum([0, *widths])
    for batch in batches:
        ids, label, weight, bins = _batch_arrays(batch, len(widths))
        for tree, nodes in wanted.items():
            slots = np.full(len(tops[tree].left), -1)
            slots[nodes] = np.arange(len(nodes))
            times = drawn(ids, tree, rules)
            slot = slots[tops[tree].ends(bins)]
            at = np.flatnonzero((times > 0) & (slot >= 0))
            stats = _stats(times[at], label[at], weight[at], rules)
            held = total.setdefault(tree, np.zeros((len(nodes), rows, ends[-1])))
            for f, width in enumerate(widths):
                held[:, :, ends[f] : ends[f + 1]] += _cells(bins[at, f], slot[at], stats, len(nodes), width).transpose(1, 0, 2)
    for tree, held in total.items():
        yield pa.RecordBatch.from_pydict(
            {
                "tree": pa.array([tree] * len(held), pa.int32()),
                "node": pa.array(wanted[tree], pa.int32()),
                "sums": pa.array([x.tobytes() for x in held], pa.binary()),
            }
        )


def _pick(pdf: pd.DataFrame, tops: dict[int, Top], widths: list[int], rules: Rules) -> pd.DataFrame:
    """The split of one node from the sums of all tasks."""
    tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
    ends = np.cumsum([0, *widths])
    sums = sum(np.frombuffer(x).reshape(-1, ends[-1]) for x in pdf["sums"])
    total = sums[:, : widths[0]].sum(axis=1)
    may = allowed(np.array([tops[tree].path[node]]), tree, len(widths), rules)
    best, left = (0.0, -1, 0), 0.0
    for f in range(len(widths)):
        if may is None or may[0, f]:
            below = np.cumsum(sums[:, ends[f] : ends[f + 1]], axis=1)[:, :-1]
            gain = _gains(below, total[:, None], rules)
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best, left = (float(gain[cut]), f, cut), float(below[0, cut])
    return pd.DataFrame([(tree, node, *best, left, total.tolist())], columns=["tree", "node", "gain", "feature", "cut", "left_rows", "sums"])


def _tops(stored: DataFrame, count: int, cuts: list[np.ndarray], rules: Rules, local_rows: int) -> dict[int, Top]:
    """Tops of all trees: no end holds more than ``local_rows`` draws, but for ends that can not be split.

    A level's sums take one narrow row per (task, tree, node), and the driver gets one split per node.
    """
    tops = {t: Top() for t in range(rules.trees)}
    widths = [len(c) + 2 for c in cuts]
    wanted = {t: [0] for t in tops} if count > local_rows else {}
    for _ in range(rules.max_depth):
        if not wanted:
            break
        now = dict(wanted)
        sums = stored.mapInArrow(lambda batches, now=now: _level_sums(batches, tops, now, widths, rules), "tree int, node int, sums binary")
        found = sums.groupBy("tree", "node").applyInPandas(
            lambda pdf: _pick(pdf, tops, widths, rules),
            "tree int, node int, gain double, feature int, cut int, left_rows double, sums array<double>",
        )
        wanted = {}
        for r in sorted(found.collect(), key=lambda r: (r["tree"], r["node"])):
            if r["gain"] > 0:
                left, right = tops[r["tree"]].split(r["node"], r["feature"], r["cut"], r["gain"], list(r["sums"]))
                rows = {left: r["left_rows"], right: r["sums"][0] - r["left_rows"]}
                wanted.setdefault(r["tree"], []).extend(n for n in rows if rows[n] > local_rows)
        wanted = {t: nodes for t, nodes in wanted.items() if nodes}
    return tops


def _row_type(width: int) -> np.dtype:
    return np.dtype([("bins", np.uint8, (width,)), ("times", np.uint8), ("label", float), ("weight", float)])


def _deal(batches: Iterator[pa.RecordBatch], tops: dict[int, Top], slots: dict[int, np.ndarray], width: int, rules: Rules):
    """Rows drawn by each tree, packed by the end they come to: ``slot, rows``."""
    for batch in batches:
        ids, label, weight, bins = _batch_arrays(batch, width)
        for tree, top in tops.items():
            times = drawn(ids, tree, rules)
            at = np.flatnonzero(times)
            slot = slots[tree][top.ends(bins[at])]
            order = np.argsort(slot, kind="stable")
            at, slot = at[order], slot[order]
            packed = np.empty(len(at), _row_type(width))
            packed["bins"], packed["times"], packed["label"], packed["weight"] = bins[at], times[at], label[at], weight[at]
            some, starts = np.unique(slot, return_index=True)
            parts = [p.tobytes() for p in np.split(packed, starts[1:])] if len(some) else []
            yield pa.RecordBatch.from_pydict({"slot": pa.array(some, pa.int64()), "rows": pa.array(parts, pa.binary())})


def _grow_slots(batches: Iterator[pa.RecordBatch], where: dict[int, tuple[int, int]], cuts: list[np.ndarray], rules: Rules):
    """Nodes below each end; the rows of an end come together."""

    def done() -> pa.RecordBatch:
        rows = np.concatenate([np.frombuffer(p, _row_type(len(cuts))) for p in held])
        stats = _stats(rows["times"], rows["label"], rows["weight"], rules)
        found = grow(np.ascontiguousarray(rows["bins"].T), stats, *where[key], cuts, rules)
        sums, n = found.pop("sums"), len(found["feature"])
        lists = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32), sums.ravel())
        columns = [np.full(n, key), np.arange(n), found["feature"].astype(np.int32), found["threshold"], found["gain"], found["left_id"], lists]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split(" ")[0] for c in _NODES.split(", ")])

    key, held = None, []
    for batch in batches:
        for slot, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if slot != key:
                if key is not None:
                    yield done()
                key, held = slot, []
            held.append(rows)
    if key is not None:
        yield done()


def _binned(dataset: DataFrame, weight: str | None) -> tuple[DataFrame, list[np.ndarray], int]:
    """(stored table ``id, label, weight, bins``, cut points, number of rows)."""
    rows = dataset.select(
        F.col("label").cast("double").alias("label"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        vector_to_array("features").alias("x"),
        F.lit(0).alias("one"),
        *([F.xxhash64(ROW_ID).alias("id")] if ROW_ID in dataset.columns else []),
    )
    rows = materialize(rows, "forest-rows")
    count, known, width = rows.agg(F.count("*"), F.count(F.nanvl("label", F.lit(None).cast("double"))), F.max(F.size("x"))).first()
    if not count or known < count:
        raise ValueError("a forest needs training rows, all with a label")
    cuts = quantile_cuts(rows, width, "one")[0]

    def binned(batches):
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, width))
            bins = to_bins(x, cuts)
            for k, c in enumerate(cuts):  # missing values lie above all others
                bins[bins[:, k] == MISSING, k] = len(c) + 1
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "weight": batch["weight"], "bins": [b.tobytes() for b in bins]})

    numbered = (rows if "id" in rows.columns else rows.withColumn("id", F.monotonically_increasing_id())).select("id", "label", "weight", "x")
    stored = materialize(numbered.mapInPandas(binned, "id long, label double, weight double, bins binary"), "forest-binned")
    return stored, cuts, count


def fit_nodes(dataset: DataFrame, rules: Rules, weight: str | None = None, local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """(``tree, id, feature, threshold, gain, left_id, right_id, sums`` of all nodes, cut points). ``id`` runs from 0 in each tree.

    Without tops the trees are grown as the frame is read, so read it once.
    """
    spark = dataset.sparkSession
    stored, cuts, count = _binned(dataset, weight)
    width = len(cuts)
    tops = _tops(stored, count, cuts, rules, local_rows)
    slots, where, upper = {}, {}, []
    for tree, top in tops.items():
        slots[tree] = np.full(len(top.left), -1)
        for node, left in enumerate(top.left):
            if left < 0:
                slots[tree][node] = len(where)
                where[len(where)] = tree, top.path[node]
    dealt = stored.mapInArrow(lambda batches: _deal(batches, tops, slots, width, rules), "slot long, rows binary")
    tasks = min(len(where), TASKS)
    dealt = dealt.repartitionById(tasks, (F.col("slot") % tasks).cast("int")).sortWithinPartitions("slot")
    lower = dealt.mapInArrow(lambda batches: _grow_slots(batches, where, cuts, rules), _NODES)
    if len(where) == rules.trees:  # every tree is one rest, whose number is that of the tree
        right = F.when(F.col("left_id") >= 0, F.col("left_id") + 1).otherwise(-1)
        whole = ("id", "feature", "threshold", "gain", "left_id", right.alias("right_id"), "sums")
        return lower.select(F.col("slot").cast("int").alias("tree"), *whole), cuts
    lower = materialize(lower, "forest-nodes")
    # Inner nodes of a top come first, then the nodes below each of its ends.
    sizes = {r["slot"]: r["count"] for r in lower.groupBy("slot").count().collect()}
    places, rest = [], (1 + rules.classes if rules.classes else 3)
    for tree, top in tops.items():
        inner = [n for n, left in enumerate(top.left) if left >= 0]
        ids, free = {n: k for k, n in enumerate(inner)}, len(inner)
        for node, slot in enumerate(slots[tree].tolist()):
            if slot >= 0:
                ids[node] = free
                places.append((slot, tree, free))
                free += sizes.get(slot, 0)
        for n in inner:
            # Spark keeps the left child's id and the right one's; they need not be neighbours here.
            f, c = top.feature[n], top.cut[n]
            at = float(cuts[f][c]) if c < len(cuts[f]) else math.inf
            upper.append((tree, ids[n], f, at, top.gain[n], ids[top.left[n]], ids[top.left[n] + 1], [float(s) for s in top.sums[n][:rest]]))
    offsets = spark.createDataFrame(places, "slot long, tree int, ahead long")
    child = lambda k: F.when(F.col("left_id") >= 0, F.col("left_id") + F.col("ahead") + k).otherwise(-1)
    nodes = lower.join(F.broadcast(offsets), "slot").select(
        "tree", (F.col("id") + F.col("ahead")).alias("id"), "feature", "threshold", "gain",
        child(0).alias("left_id"), child(1).alias("right_id"), "sums",
    )
    if upper:
        schema = "tree int, id long, feature int, threshold double, gain double, left_id long, right_id long, sums array<double>"
        nodes = nodes.unionByName(spark.createDataFrame(upper, schema))
    return nodes, cuts


class Forest(Estimator):
    """Random forest on ``label`` and ``features``."""

    def __init__(self, rules: Rules, classification: bool, weight: str | None = None, root_subset: bool = False):
        super().__init__()
        self.rules, self.classification, self.weight, self.root_subset = rules, classification, weight, root_subset

    def _fit(self, dataset: DataFrame) -> Model:
        rules, spark = self.rules, dataset.sparkSession
        heads = dataset.agg(F.max("label").alias("top"), F.max(F.size(vector_to_array("features"))).alias("width")).first()
        if heads["top"] is None:
            raise ValueError("a forest needs training rows, all with a label")
        classes = max(2, int(heads["top"]) + 1) if self.classification else 0
        subset = math.ceil(math.sqrt(heads["width"])) if self.root_subset else rules.subset
        rules = Rules(rules.trees, rules.max_depth, rules.min_leaf, subset, classes, rules.seed)
        nodes, cuts = fit_nodes(dataset, rules, self.weight)
        path = scratch_path(spark, "forest")
        _write(nodes, path, rules, len(cuts))
        count = spark.read.parquet(f"{path}/data").count()
        return ForestModel(path, rules.trees, classes, count, [c.tolist() for c in cuts])


def _pack(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of binned rows with consecutive numbers: ``first, bins``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0).to_numpy()
        bins = to_bins(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), cuts)
        jumps = np.flatnonzero(np.diff(rows) != 1) + 1
        starts = [low for a, b in zip([0, *jumps], [*jumps, len(rows)]) for low in range(a, b, BLOCK)]
        parts = [bins[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)])]
        yield pa.RecordBatch.from_pydict({"first": pa.array(rows[starts], pa.int64()), "bins": pa.array(parts, pa.binary())})


class Trees:
    """Nodes of some trees, end to end."""

    def __init__(self, cuts: list[np.ndarray], size: int) -> None:
        self.cuts, self.size, self.held, self.roots = cuts, size, [], []

    def add(self, batch: pa.RecordBatch) -> None:
        tree, id_, feature, threshold, left, right = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 8))
        cut = np.zeros(len(tree), np.uint8)
        for f in np.unique(feature[feature >= 0]):
            at = feature == f
            cut[at] = np.searchsorted(self.cuts[f], threshold[at], "left")
        value = np.zeros((len(tree), self.size))
        value[feature < 0] = batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.size)
        self.held.append((tree, id_, feature, cut, left, right, value))

    def close(self) -> None:
        tree, id_, feature, cut, left, right, value = (np.concatenate(c) for c in zip(*self.held))
        found, slot, counts = np.unique(tree, return_inverse=True, return_counts=True)
        self.roots = np.cumsum(counts) - counts
        place = np.empty(len(tree), np.int64)
        place[self.roots[slot] + id_] = np.arange(len(tree))
        self.inner, self.value = feature[place] >= 0, value[place]
        # A leaf is its own child, so rows may come to it some levels before the others.
        self.feature, self.cut = np.where(self.inner, feature[place], 0).astype(np.intp), cut[place]
        own = np.arange(len(tree))
        self.child = np.stack([np.where(self.inner, (c + self.roots[slot])[place], own) for c in (left, right)], axis=1).ravel()
        self.held = []

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """Sum of the values of all trees for each binned row."""
        flat, starts, out = bins.ravel(), np.arange(len(bins)) * bins.shape[1], np.zeros((len(bins), self.size))
        for root in self.roots:
            node = np.full(len(bins), root)
            rows = np.arange(len(bins)) if self.inner[root] else np.zeros(0, np.int64)
            at, base = node[rows], starts[rows]
            while len(rows):
                for _ in range(LEVELS):
                    right = flat.take(base + self.feature.take(at)) > self.cut.take(at)
                    at = self.child.take(2 * at + right)
                live = self.inner.take(at)
                node[rows] = at
                rows, at, base = rows[live], at[live], base[live]
            out += self.value[node]
        return out


def _vote(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], size: int, of: Callable[[Trees, bytes], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What ``of`` gives for each group's trees and each block. Of a (group, part of the rows) the nodes come first, then the blocks."""
    key, trees, ready = None, None, False
    for batch in batches:
        groups, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(groups) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(groups)]):
            some = batch.slice(a, b - a)
            if groups[a] != key:
                key, trees, ready = groups[a], Trees(cuts, size), False
            if not blocks[a]:
                trees.add(some)
                continue
            if not ready:
                trees.close()
                ready = True
            for first, bins in zip(some.column(9).to_pylist(), some.column(10).to_pylist()):
                votes = of(trees, bins)
                yield pa.RecordBatch.from_pydict({"first": pa.array([first]), "group": pa.array([key], pa.int32()), "votes": pa.array([votes.tobytes()])})


def _added(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Votes of all groups on the rows of one block, always added up in the same order."""
    votes = reduce(np.add, (np.frombuffer(v).reshape(-1, size) for v in pdf.sort_values("group")["votes"]))
    return pd.DataFrame({"_row": int(pdf["first"].iloc[0]) + np.arange(len(votes)), "_votes": list(votes)})


class ForestModel(Model, MLWritable, MLReadable):
    """Forest stored at ``path`` as Spark ML stores it; ``classes`` is 0 in regression.

    ``transform`` predicts at once: the rows are written with a number each, the votes are stored by number.
    """

    def __init__(self, path: str, trees: int, classes: int, nodes: int, cuts: list[list[float]]):
        super().__init__()
        self.path, self.getNumTrees, self.classes, self.nodes, self.cuts = path, trees, classes, nodes, cuts

    @property
    def numFeatures(self) -> int:
        return len(self.cuts)

    @property
    def numClasses(self) -> int:
        return self.classes

    def _nodes(self, spark: SparkSession) -> DataFrame:
        node = F.col("nodeData")
        stats = node["impurityStats"]
        total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        shares = F.transform(stats, lambda x: F.when(total == 0, 0.0).otherwise(x / total))
        return spark.read.parquet(f"{self.path}/data").select(
            F.col("treeID").alias("tree"), node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
            F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], 0), F.lit(0.0)).alias("threshold"),
            node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["gain"].alias("gain"),
            (total if self.classes else stats[0]).alias("weight"),
            (shares if self.classes else F.array(node["prediction"])).alias("value"),
        )

    def votes(self, blocks: DataFrame, rows: int, of: Callable[[Trees, bytes], np.ndarray], size: int, least: int) -> DataFrame:
        """What ``of`` gives for the trees, group by group, and each block (``first, bins``), added up over the groups.

        ``rows``: rows of all blocks together; of each, numbered from ``first`` in its block as ``_row``, ``size`` numbers come out
        as ``_votes``. ``least``: groups of trees, at least.
        """
        cuts, held = [np.array(c) for c in self.cuts], max(1, self.classes)
        groups = min(self.getNumTrees, max(least, -(-self.nodes // GROUP_NODES)))
        parts = max(1, -(-rows // PART_ROWS))
        none = lambda kind: F.lit(None).cast(kind)
        # A task has the nodes of one group and one part of the blocks.
        task = lambda group, part: (group * parts + part).cast("int")
        nodes = self._nodes(blocks.sparkSession).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        nodes = nodes.select(
            task(F.col("tree") % groups, F.col("part")).alias("group"), F.lit(False).alias("block"), "tree", "id", "feature", "threshold", "left", "right",
            F.when(F.col("feature") < 0, F.col("value")).otherwise(F.array().cast("array<double>")).alias("value"),
            none("long").alias("first"), none("binary").alias("bins"),
        )
        asked = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
            task(F.col("group"), F.pmod(F.xxhash64("first"), F.lit(parts))).alias("group"), F.lit(True).alias("block"),
            *[none(kind).alias(c) for c, kind in nodes.dtypes[2:9]], "first", "bins",
        )
        dealt = nodes.unionByName(asked).repartitionById(min(groups * parts, TASKS), (F.col("group") % min(groups * parts, TASKS)).cast("int"))
        votes = dealt.sortWithinPartitions("group", "block").mapInArrow(lambda batches: _vote(batches, cuts, held, of), _VOTES)
        return votes.groupBy("first").applyInPandas(lambda pdf: _added(pdf, size), "_row long, _votes array<double>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cuts, size, kept = [np.array(c) for c in self.cuts], max(1, self.classes), "first long, bins binary"
        stored = materialize(dataset.withColumn("_row", F.monotonically_increasing_id()), "to-predict")
        blocks = stored.select("_row", vector_to_array("features").alias("x")).mapInArrow(lambda batches: _pack(batches, cuts), kept)
        width = len(cuts)
        added = self.votes(blocks, stored.count(), lambda trees, bins: trees.votes(np.frombuffer(bins, np.uint8).reshape(-1, width)), size, GROUPS)
        scored = stored.join(materialize(added, "votes"), "_row").drop("_row")
        if not self.classes:
            return scored.withColumn("prediction", F.col("_votes")[0] / self.getNumTrees).drop("_votes")
        total = F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x)
        shares = F.transform("_votes", lambda x: x / total)
        best = (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")
        return scored.withColumns(
            {"rawPrediction": array_to_vector("_votes"), "probability": array_to_vector(shares), "prediction": best}
        ).drop("_votes")

    @property
    def featureImportances(self) -> DenseVector:
        """Gain by feature, weighted by the rows of the node; every tree counts the same."""
        inner = self._nodes(SparkSession.active()).where("feature >= 0")
        gains = inner.groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
        share = F.col("gain") / F.sum("gain").over(Window.partitionBy("tree"))
        found = gains.withColumn("share", share).groupBy("feature").agg(F.sum("share").alias("share")).collect()
        out = np.zeros(len(self.cuts))
        for r in found:
            out[r["feature"]] = r["share"]
        return Vectors.dense(out / (out.sum() or 1.0))

    def spark_model(self) -> Model:
        """The model of Spark ML, which holds all nodes in the driver."""
        return (RandomForestClassificationModel if self.classes else RandomForestRegressionModel).load(self.path)

    @property
    def trees(self) -> list[Model]:
        return self.spark_model().trees

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


_KEPT = ("getNumTrees", "classes", "nodes", "cuts")


class _ForestWriter(MLWriter):
    """Settings, and the stored forest as it is."""

    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, model = self.sparkSession, self.model
        DefaultParamsWriter.saveMetadata(model, path, spark, {k: getattr(model, k) for k in _KEPT})
        for part in ("data", "treesMetadata"):
            spark.read.parquet(f"{model.path}/{part}").write.parquet(f"{path}/forest/{part}")
        spark.read.text(f"{model.path}/metadata").coalesce(1).write.text(f"{path}/forest/metadata")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        found = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        return ForestModel(f"{path}/forest", *[found[k] for k in _KEPT])._resetUid(found["uid"])


def _write(nodes: DataFrame, path: str, rules: Rules, width: int) -> None:
    """The forest as Spark ML stores it."""
    spark, total = nodes.sparkSession, F.col("sums")
    if rules.classes:
        stats = F.slice(total, 2, rules.classes)
        weight = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        impurity = 1 - F.aggregate(stats, F.lit(0.0), lambda a, x: a + x * x) / (weight * weight)
        prediction = (F.array_position(stats, F.array_max(stats)) - 1).cast("double")
        kind, tree_kind, short = "classification.RandomForestClassificationModel", "classification.DecisionTreeClassificationModel", "gini"
    else:
        stats, prediction = total, total[1] / total[0]
        impurity = F.greatest(total[2] / total[0] - prediction * prediction, F.lit(0.0))
        kind, tree_kind, short = "regression.RandomForestRegressionModel", "regression.DecisionTreeRegressionModel", "variance"
    threshold = F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>"))
    data = F.struct(
        F.col("id").cast("int").alias("id"), prediction.alias("prediction"), impurity.alias("impurity"), stats.alias("impurityStats"),
        total[0].cast("long").alias("rawCount"), "gain", F.col("left_id").cast("int").alias("leftChild"),
        F.col("right_id").cast("int").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), threshold.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split"),
    )
    nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.parquet(f"{path}/data")
    settings = {"maxDepth": rules.max_depth, "minInstancesPerNode": rules.min_leaf, "seed": rules.seed}

    def head(name: str, uid: str, **more: object) -> str:
        found = {"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid}
        return json.dumps({**found, "paramMap": settings, "defaultParamMap": {"impurity": short}, **more})

    counts = {"numFeatures": width, "numTrees": rules.trees, **({"numClasses": rules.classes} if rules.classes else {})}
    settings_all = [(t, head(tree_kind, f"tree_{t}"), 1.0) for t in range(rules.trees)]
    spark.createDataFrame(settings_all, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    top = json.loads(head(kind, path.rsplit("/", 1)[-1], **counts))
    top["paramMap"] = {**settings, "numTrees": rules.trees}
    spark.createDataFrame([(json.dumps(top),)], "value string").coalesce(1).write.text(f"{path}/metadata")

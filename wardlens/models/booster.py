"""Gradient boosting on binned features, many models in one pass.

Each feature is cut at quantiles into at most BINS bins, and missing values have a bin of their own whose side is
learned in every split. The binned rows are written once. A pass over them adds up gradient, Hessian and count for
each (model, node, feature, bin that occurs) inside the tasks, and those of a node are added up in one task, which picks its
split; only the split of each node and the sums of its two sides reach the driver.

Models of at most ``LOCAL_ROWS`` rows and ``LOCAL_CELLS`` bytes of bins each are boosted in one job, each model in a task of its
own by the same steps, since starting five or more jobs a round takes longer than their work. There, of two children only the
smaller one is counted; the other is the parent less its sibling. The levels of a category share a column, and columns of few
bins are counted by one key (``_Held``).

A tree grows best-first to ``max_leaves``. A pass looks at the children of all leaves that may still be split, not only of
the best one, so a tree takes about as many passes as it has levels and still is the one that single steps would grow.

Models that differ in their rows only, such as the fits of a cross-validation, are grown together: ``fit_many``.
The running predictions live in persisted blocks; every CHECKPOINT rounds they are checkpointed in the shared folder, so a lost
executor costs some trees at most.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.models.bins import BINS, MISSING, quantile_cuts, to_bins
from wardlens.models.forest import share_columns
from wardlens.sources.scratch import materialize, scratch_root

CHECKPOINT = 50
CHUNK = 1 << 15
NARROW = 8  # features with rows in no more bins than that are searched apart
LOCAL_ROWS = 1 << 20  # of a model that one task boosts
LOCAL_CELLS = 1 << 26  # bytes of bins of such a model
PACKED = 1 << 12  # cells of columns that are counted together
ADDERS = 2  # tasks that add up the sums of all partitions and pick the splits
_WIDE = BINS + 1


@dataclass(frozen=True)
class Growth:
    """Rules of growth. ``l2`` is added to Hessian sums; a leaf adds ``-rate * G / (H + l2)``."""

    rounds: int = 100
    rate: float = 0.1
    max_leaves: int = 31
    max_depth: int = 64
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    classification: bool = False


@dataclass
class Tree:
    """Nodes as arrays; ``feature`` is -1 in leaves. Rows whose bin is at most ``cut`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])  # the right child follows the left one

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> int:
        """Give ``node`` two children; returns the left one."""
        child = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node] = feature, cut, missing_left, child
        for column, start in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.value, 0.0)):
            column += [start, start]
        return child

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of every binned row."""
        feature, cut, missing_left, left = (np.array(c) for c in (self.feature, self.cut, self.missing_left, self.left))
        node = np.zeros(len(bins), np.int64)
        rows = np.flatnonzero(feature[node] >= 0)
        while len(rows):
            at = node[rows]
            bin_ = bins[rows, feature[at]]
            goes_left = np.where(bin_ == MISSING, missing_left[at], bin_ <= cut[at])
            node[rows] = left[at] + ~goes_left
            rows = rows[feature[node[rows]] >= 0]
        return node


def best_split(sums: np.ndarray, rules: Growth) -> tuple[float, int, int, bool]:
    """(gain, feature, cut, side of missing values) of the best split of a node; gain 0 if none is allowed.

    ``sums`` has gradient, Hessian and count by feature and bin. Ties go to the lower feature, then the lower cut,
    then to the right side for missing values. Without missing values in the node they follow the larger child.
    """
    missing, total = sums[:, MISSING], sums[0].sum(axis=0)

    def score(x: np.ndarray) -> np.ndarray:
        return x[..., 0] ** 2 / np.maximum(x[..., 1] + rules.l2, 1e-12)

    # Cuts above a feature's last bin with rows equal the one at that bin, so few-valued features need few cuts.
    narrow = ~sums[:, NARROW:MISSING, 2].any(axis=1)
    best = (0.0, 0, 0, False)
    for features, cuts in ((np.flatnonzero(narrow), NARROW), (np.flatnonzero(~narrow), MISSING - 1)):
        if not len(features):
            continue
        below = np.cumsum(sums[features, :cuts], axis=1)
        left = np.stack([below, below + missing[features][:, None]], axis=2)  # feature, cut, side, sum
        right = total - left
        gain = score(left) + score(right) - score(total)
        for side in (left, right):
            gain = np.where((np.round(side[..., 2]) >= rules.min_rows) & (side[..., 1] >= rules.min_hessian), gain, 0.0)
        gain = np.round(gain, 9)
        at, cut, side = np.unravel_index(int(np.argmax(gain)), gain.shape)
        feature, top = int(features[at]), float(gain[at, cut, side])
        if top <= 0 or (top, -feature) <= (best[0], -best[1]):
            continue
        if missing[feature, 2] < 0.5:
            side, top = left[at, cut, 0, 2] > right[at, cut, 0, 2], float(gain[at, cut, 0])
        best = top, feature, int(cut), bool(side)
    return best


Look = tuple[tuple[float, int, int, bool], tuple[float, ...], tuple[float, ...]]


def look_at(sums: np.ndarray, rules: Growth) -> Look:
    """(best split of a node, sums of the node, sums of the left side of that split)."""
    best = _, feature, cut, missing_left = best_split(sums, rules)
    left = sums[feature, : cut + 1].sum(axis=0) + (sums[feature, MISSING] if missing_left else 0)
    return best, tuple(sums[0].sum(axis=0).tolist()), tuple(left.tolist())


class _Grower:
    """A tree under way: ``wide`` is split further than the tree may become; the rest belongs to its nodes."""

    def __init__(self, rules: Growth) -> None:
        self.rules, self.wide = rules, Tree()
        self.best: dict[int, tuple[float, int, int, bool]] = {}
        self.total: dict[int, np.ndarray] = {}
        self.left: dict[int, np.ndarray] = {}
        self.depth, self.parent = {0: 0}, {}

    def add(self, node: int, look: Look) -> None:
        self.best[node], self.total[node], self.left[node] = look[0], np.array(look[1]), np.array(look[2])
        if self.depth[node] >= self.rules.max_depth:
            self.best[node] = (0.0, 0, 0, False)

    def select(self) -> tuple[set[int], list[int]]:
        """(nodes split so far when the best goes first, leaves whose children must be known to go on)."""
        split, open_ = set(), [0]
        while len(open_) < self.rules.max_leaves:
            some = [n for n in open_ if n is not None and self.best[n][0] > 0]
            if not some:
                break
            node = max(some, key=lambda n: (self.best[n][0], -n))
            if self.wide.feature[node] < 0:
                if self._last(node) or len(open_) + 1 == self.rules.max_leaves:
                    split.add(node)  # its children stay leaves, whose values follow from its own sums
                    open_[open_.index(node)] = None
                    open_.append(None)
                    continue
                room = self.rules.max_leaves - len(open_)
                wanted = (n for n in some if self.wide.feature[n] < 0 and not self._last(n))
                return split, sorted(wanted, key=lambda n: -self.best[n][0])[:room]
            split.add(node)
            open_.remove(node)
            open_ += [self.wide.left[node], self.wide.left[node] + 1]
        return split, []

    def _last(self, node: int) -> bool:
        """Whether the children of a node can not be split."""
        return self.depth[node] + 1 >= self.rules.max_depth

    def expand(self, nodes: list[int]) -> list[int]:
        """Split leaves of the wide tree; returns their children, in pairs."""
        for node in nodes:
            child = self.wide.split(node, *self.best[node][1:])
            self.depth[child] = self.depth[child + 1] = self.depth[node] + 1
            self.parent[child] = self.parent[child + 1] = node
        return [child for node in nodes for child in (self.wide.left[node], self.wide.left[node] + 1)]

    def smaller(self, node: int) -> int:
        """The child of a node that has fewer rows."""
        return self.wide.left[node] + (2 * self.left[node][2] > self.total[node][2])

    def tree(self, split: set[int]) -> Tree:
        """The selected part, with its leaf values."""
        out, todo = Tree(), [(0, 0)]
        while todo:
            old, new = todo.pop()
            if old in split:
                _, feature, cut, missing_left = self.best[old]
                child = out.split(new, feature, cut, missing_left)
                if self.wide.feature[old] >= 0:
                    todo += [(self.wide.left[old], child), (self.wide.left[old] + 1, child + 1)]
                else:  # a split whose children were never counted
                    for k, part in ((child, self.left[old]), (child + 1, self.total[old] - self.left[old])):
                        out.value[k] = self._value(part)
            else:
                out.value[new] = self._value(self.total[old])
        return out

    def _value(self, sums: np.ndarray) -> float:
        return float(-self.rules.rate * sums[0] / max(sums[1] + self.rules.l2, 1e-12))


@dataclass
class Ensemble:
    """Start value, trees and the cut points of the features."""

    start: float
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Output for rows of features; features that only models grown beside this one have count as missing."""
        absent = np.full((len(x), max(0, len(self.cuts) - x.shape[1])), np.nan)
        bins = to_bins(np.concatenate([x, absent], axis=1), self.cuts)
        return self.start + sum((np.array(t.value)[t.leaves(bins)] for t in self.trees), np.zeros(len(x)))


def _gradients(y: np.ndarray, raw: np.ndarray, classification: bool) -> tuple[np.ndarray, np.ndarray]:
    if not classification:
        return raw - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-raw))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def _sums(block: dict, trees: dict, counted: dict, rules: Growth) -> dict:
    """Sums of the counted nodes of each model in a block of rows."""
    out = {}
    for model, nodes in counted.items():
        if model not in block:
            continue
        bins, y, raw = block[model]
        width = bins.shape[1]
        slot = np.full(len(trees[model].feature), -1)
        slot[nodes] = np.arange(len(nodes))
        total = np.zeros((3, len(nodes), width, _WIDE))
        for low in range(0, len(y), CHUNK):
            part = slice(low, low + CHUNK)
            at = slot[trees[model].leaves(bins[part])]
            rows = np.flatnonzero(at >= 0)
            g, h = _gradients(y[part][rows], raw[part][rows], rules.classification)
            start, mine = at[rows] * _WIDE, np.ascontiguousarray(bins[part][rows].T)
            for f in range(width):
                key = start + mine[f]
                count = np.bincount(key, minlength=len(nodes) * _WIDE).reshape(-1, _WIDE)
                total[0, :, f] += np.bincount(key, g, len(nodes) * _WIDE).reshape(-1, _WIDE)
                total[1, :, f] += np.bincount(key, h, len(nodes) * _WIDE).reshape(-1, _WIDE) if rules.classification else count
                total[2, :, f] += count
        out[model] = total.transpose(1, 2, 3, 0)
    return out


def _totals(blocks: RDD, trees: dict, counted: dict, rules: Growth, kept: dict, of: Callable[[np.ndarray], object] = lambda sums: sums) -> dict:
    """What ``of`` gives for the sums over all blocks of each counted node, worked out in the tasks. Only cells in which a row
    can lie (``kept``) leave a task."""

    def parts(number, rows):
        for block in rows:
            for model, sums in _sums(block, trees, counted, rules).items():
                for k, mine in enumerate(sums):
                    yield (model, k), (number, mine[kept[model]])

    def added(item):
        (model, k), found = item
        sums = np.zeros((*kept[model].shape, 3))
        sums[kept[model]] = reduce(np.add, (mine for _, mine in sorted(found, key=lambda x: x[0])))  # always in the same order
        return (model, k), of(sums)

    found = dict(blocks.mapPartitionsWithIndex(parts).groupByKey(min(ADDERS, blocks.getNumPartitions())).map(added).collect())
    return {m: [found[m, k] for k in range(len(nodes))] for m, nodes in counted.items()}


def _stepped(block: dict, trees: dict) -> dict:
    """The block with the new trees in its predictions."""
    return {m: (bins, y, raw + np.array(trees[m].value)[trees[m].leaves(bins)]) for m, (bins, y, raw) in block.items()}


def _blocks(stored: DataFrame, starts: dict, width: int) -> RDD:
    def build(rows):
        found: dict = {}
        for model, label, bins in rows:
            mine = found.setdefault(model, ([], []))
            mine[0].append(bytes(bins))
            mine[1].append(label)
        yield {
            m: (np.frombuffer(b"".join(b), np.uint8).reshape(-1, width), np.array(y, float), np.full(len(y), starts[m]))
            for m, (b, y) in found.items()
        }

    return stored.select("model", "label", "bins").rdd.map(tuple).mapPartitions(build)


def fit_many(df: DataFrame, rules: Growth, by: str) -> dict[object, Ensemble]:
    """An ensemble for each value of ``by``, fitted on its rows of ``label, features``. Rows without a label are left out."""
    spark = df.sparkSession
    rows = df.where("label IS NOT NULL").select(F.col(by).alias("model"), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    heads = rows.groupBy("model").agg(F.avg("label").alias("mean"), F.max(F.size("x")).alias("width")).collect()
    if not heads:
        return {}
    # Models may have different features; shorter rows are filled up with missing values.
    width = max(r["width"] for r in heads)
    filled = F.concat("x", F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size("x")))
    rows = rows.withColumn("x", filled)
    cuts = quantile_cuts(rows, width, "model")
    kind = rows.schema["model"].dataType.simpleString()

    def binned(batches):
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, width))
            bins = np.zeros(x.shape, np.uint8)
            for model, at in batch.groupby("model").indices.items():
                bins[at] = to_bins(x[at], cuts[model])
            yield pd.DataFrame({"model": batch["model"], "label": batch["label"], "bins": [b.tobytes() for b in bins]})

    rows = rows.hint("rebalance")  # partitions by size, not by number: a pass over few rows is one task
    stored = materialize(rows.mapInPandas(binned, f"model {kind}, label double, bins binary"), "binned")
    starts = {r["model"]: r["mean"] for r in heads}
    if rules.classification:
        starts = {m: float(np.log(max(p, 1e-12) / max(1 - p, 1e-12))) for m, p in starts.items()}
    fitted = {m: Ensemble(starts[m], cuts[m]) for m in starts}
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"{scratch_root(spark)}/wardlens/rounds")
    most = stored.groupBy("model").count().agg(F.max("count")).first()[0]
    if most <= LOCAL_ROWS and most * width <= LOCAL_CELLS:
        for m, trees in _fit_apart(stored, starts, width, rules).items():
            fitted[m].trees = trees
        return fitted
    blocks = _blocks(stored, starts, width)
    kept = {m: np.zeros((width, _WIDE), bool) for m in cuts}
    for m, found in cuts.items():
        kept[m][:, MISSING] = True
        for k, c in enumerate(found):
            kept[m][k, : len(c) + 1] = True
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    old: list[RDD] = []
    for number in range(rules.rounds):
        trees = _round(lambda growers, counted, blocks=blocks: _looks(blocks, growers, counted, rules, kept), sorted(fitted), rules)
        for m, tree in trees.items():
            fitted[m].trees.append(tree)
        after = blocks.map(lambda block, trees=trees: _stepped(block, trees)).persist(StorageLevel.MEMORY_AND_DISK)
        if number % CHECKPOINT == CHECKPOINT - 1:
            after.checkpoint()
        old, blocks = [*old, blocks], after
        if number % CHECKPOINT == CHECKPOINT - 1:
            after.count()
        while len(old) > 1 or (old and number % CHECKPOINT == CHECKPOINT - 1):  # the last step's blocks are still read by the next pass
            old.pop(0).unpersist()
    for rdd in [*old, blocks]:
        rdd.unpersist()
    return fitted


def _looks(blocks: RDD, growers: dict[object, _Grower], counted: dict, rules: Growth, kept: dict) -> dict[object, list[Look]]:
    """The counted nodes by a pass over the blocks."""
    return _totals(blocks, {m: growers[m].wide for m in counted}, counted, rules, kept, lambda sums: look_at(sums, rules))


class _Held:
    """Rows of one model in a task.

    Two-valued features of which no row has two at the higher bin share a column (``share_columns``), and columns with few bins
    make up one key, whose sums are those of each of them when the others are added up.
    """

    def __init__(self, bins: np.ndarray, y: np.ndarray, start: float, rules: Growth) -> None:
        self.rules, self.y, self.raw = rules, y, np.full(len(y), start)
        turned = np.ascontiguousarray(bins.T)
        self.low, self.high = turned.min(axis=1).astype(int), turned.max(axis=1).astype(int)
        self.columns = share_columns(turned)
        sizes = [int(v.max()) + 1 for v in self.columns.values]
        packs: list[list[int]] = []
        for c in sorted(range(len(sizes)), key=lambda c: sizes[c]):
            if packs and math.prod(sizes[k] for k in packs[-1]) * sizes[c] <= PACKED:
                packs[-1].append(c)
            else:
                packs.append([c])
        self.packs = [(pack, [sizes[c] for c in pack]) for pack in packs]
        ends = np.cumsum([0, *[math.prod(shape) for _, shape in self.packs]]).tolist()
        self.places = [slice(a, b) for a, b in zip(ends, ends[1:])]
        self.cells = ends[-1]
        self.keys = []
        for pack, shape in self.packs:
            key = np.zeros(len(y), np.uint16)
            for c, size in zip(pack, shape):
                key = key * np.uint16(size) + self.columns.values[c]
            self.keys.append(key)
        self.rows: dict[int, np.ndarray] = {}
        self.known: dict[int, np.ndarray] = {}

    def trees(self) -> Iterator[Tree]:
        """The trees of all rounds."""
        for _ in range(self.rules.rounds):
            self.g, self.h = _gradients(self.y, self.raw, self.rules.classification)
            self.rows, self.known, seen = {0: np.arange(len(self.y))}, {}, {}

            def look(growers: dict, counted: dict, seen: dict = seen) -> dict:
                seen.update(growers)
                return {0: self._looks(growers[0], counted[0])}

            tree = _round(look, [0], self.rules)[0]
            self._step(tree, seen[0].wide)
            yield tree

    def _looks(self, grower: _Grower, nodes: list[int]) -> list[Look]:
        """The counted nodes; ``known`` has the sums of the nodes whose children are not counted yet."""
        if nodes == [0]:
            self.known[0] = self._count(self.rows[0])
        else:
            for left in nodes[::2]:
                parent = grower.parent[left]
                rows = self.rows[parent]
                side = self._left(rows, *grower.best[parent][1:])
                self.rows[left], self.rows[left + 1] = rows[side], rows[~side]
                small = grower.smaller(parent)
                self.known[small] = self._count(self.rows[small])
                self.known[2 * left + 1 - small] = self.known.pop(parent) - self.known[small]
        return [look_at(self._by_feature(self.known[n]), self.rules) for n in nodes]

    def _count(self, rows: np.ndarray) -> np.ndarray:
        """Gradient, Hessian and count (sum, cell) of the packed columns, pack by pack, and of all rows in the last cell."""
        g, h = self.g.take(rows), self.h.take(rows)
        out = np.empty((3, self.cells + 1))
        for key, at in zip(self.keys, self.places):
            mine, size = key.take(rows).astype(np.intp), at.stop - at.start
            out[0, at] = np.bincount(mine, g, size)
            out[2, at] = np.bincount(mine, minlength=size)
            out[1, at] = np.bincount(mine, h, size) if self.rules.classification else out[2, at]
        out[:, -1] = g.sum(), h.sum(), len(rows)
        return out

    def _by_feature(self, cells: np.ndarray) -> np.ndarray:
        """Sums (feature, bin, sum) of the counted cells."""
        out = np.zeros((3, len(self.low), _WIDE))
        total = cells[:, -1:]
        alike = np.flatnonzero(self.columns.column < 0)
        out[:, alike, self.low[alike]] = total
        for (pack, shape), at in zip(self.packs, self.places):
            cube = cells[:, at].reshape(3, *shape)
            for axis, c in enumerate(pack, 1):
                mine = cube.sum(axis=tuple(k for k in range(1, len(shape) + 1) if k != axis))
                members = self.columns.members[c]
                if self.columns.code[members[0]]:
                    out[:, members, self.high[members]] = mine[:, 1:]
                    out[:, members, self.low[members]] = total - mine[:, 1:]
                else:
                    out[:, members[0], : mine.shape[1]] = mine
        return out.transpose(1, 2, 0)

    def _left(self, rows: np.ndarray, feature: int, cut: int, missing_left: bool) -> np.ndarray:
        """Which rows go left."""
        column, code = self.columns.column[feature], self.columns.code[feature]
        low, high = (missing_left if b == MISSING else b <= cut for b in (self.low[feature], self.high[feature]))
        if column < 0:
            return np.full(len(rows), bool(low))
        mine = self.columns.values[column].take(rows)
        if code:
            return np.where(mine == code, bool(high), bool(low))
        left = mine <= cut
        return left | (mine == MISSING) if missing_left else left

    def _step(self, tree: Tree, wide: Tree) -> None:
        """Add a tree to the predictions. ``wide``, from which it was cut, tells whose rows are known."""
        todo = [(0, 0)]
        while todo:
            node, old = todo.pop()
            rows, child = self.rows[old], tree.left[node]
            if tree.feature[node] < 0:
                self.raw[rows] += tree.value[node]
            elif wide.feature[old] >= 0:
                todo += [(child, wide.left[old]), (child + 1, wide.left[old] + 1)]
            else:  # its children were never counted and are leaves
                side = self._left(rows, tree.feature[node], tree.cut[node], tree.missing_left[node])
                self.raw[rows] += np.where(side, tree.value[child], tree.value[child + 1])


def _fit_apart(stored: DataFrame, starts: dict, width: int, rules: Growth) -> dict[object, list[Tree]]:
    """The trees of every model, each model in a task of its own. Its rows are sorted, so the sums do not hang on their places."""
    models = sorted(starts, key=lambda m: m is not None)
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model")) - 1
    dealt = stored.select(F.coalesce(place, F.lit(0)).cast("int").alias("place"), "label", "bins")
    first = [starts[m] for m in models]

    def grown(batches):
        held: dict[int, list] = {}
        for batch in batches:
            places, label = (batch.column(c).to_numpy() for c in range(2))
            bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width)
            for k in np.unique(places):
                held.setdefault(int(k), []).append((bins[places == k], label[places == k]))
        for k, parts in held.items():
            bins, y = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            trees = list(_Held(bins, y, first[k], rules).trees())  # some kB a tree
            yield pa.RecordBatch.from_pydict({"place": pa.array([k], pa.int32()), "trees": pa.array([pickle.dumps(trees)], pa.binary())})

    dealt = dealt.repartitionById(len(models), F.col("place")).sortWithinPartitions("place", "label", "bins")
    found = dealt.mapInArrow(grown, "place int, trees binary").collect()
    return {models[r["place"]]: pickle.loads(r["trees"]) for r in found}


def _round(look: Callable[[dict, dict], dict], models: list, rules: Growth) -> dict[object, Tree]:
    """The next tree of every model; ``look`` passes over the rows and tells of each counted node."""
    growers = {m: _Grower(rules) for m in models}
    counted = {m: [0] for m in models}
    while counted:
        found, again = look(growers, counted), {}
        for m, nodes in counted.items():
            for node, seen in zip(nodes, found[m], strict=True):
                growers[m].add(node, seen)
            _, wanted = growers[m].select()
            if wanted:
                again[m] = growers[m].expand(wanted)
        counted = again
    return {m: g.tree(g.select()[0]) for m, g in growers.items()}


class Booster(Estimator):
    """``Growth`` as an estimator on ``label`` and ``features``."""

    def __init__(self, rules: Growth):
        super().__init__()
        self.rules = rules

    def _fit(self, dataset: DataFrame) -> BoosterModel:
        fitted = fit_many(dataset.withColumn("_one", F.lit(0)), self.rules, "_one")
        if not fitted:
            raise ValueError("a booster needs at least one training row with a label")
        return BoosterModel(fitted[0], self.rules.classification)


class BoosterModel(Model):
    """Adds ``rawPrediction`` (log-odds in classification) and ``prediction``."""

    def __init__(self, ensemble: Ensemble, classification: bool):
        super().__init__()
        self.ensemble, self.classification = ensemble, classification

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ensemble = self.ensemble

        @F.pandas_udf("double")
        def raw(x: pd.Series) -> pd.Series:
            return pd.Series(ensemble.raw(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        scored = dataset.withColumn("rawPrediction", raw(vector_to_array("features")))
        said = F.when(F.col("rawPrediction") > 0, 1.0).otherwise(0.0) if self.classification else F.col("rawPrediction")
        return scored.withColumn("prediction", said)

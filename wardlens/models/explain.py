"""Which columns drive a fitted model.

Three views: the split importances the forest stores, the metric lost when a column is
shuffled over all rows, and Shapley contributions of all rows (or, if asked for, of a sample).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from wardlens.functions.rounding import half_even
from wardlens.models.bins import to_bins
from wardlens.models.columns import CATEGORICAL, task_of
from wardlens.models.forest import Trees
from wardlens.models.metrics import regression_metrics, roc_auc
from wardlens.models.preprocess import feature_columns, feature_names
from wardlens.operators.ranking import number_rows
from wardlens.sources.scratch import materialize

WALKS = 1 << 10  # rows of a block
WALK_GROUPS = 24  # groups of trees that score apart, at least (if there are as many trees)


def _output(model: PipelineModel, rows: DataFrame, task: str) -> DataFrame:
    """Model output as ``output``: positive-class probability, or the predicted value."""
    value = vector_to_array("probability")[1] if task_of(task).classification else F.col("prediction")
    return model.transform(rows).withColumn("output", value)


def split_importance(model: PipelineModel, top: int | None = None) -> DataFrame:
    """Importance of every vector position as the forest stores it."""
    prepared, forest = model.stages
    pairs = list(zip(feature_names(prepared), map(float, forest.featureImportances.toArray())))
    return _small_frame(pairs, top)


def _small_frame(pairs: list[tuple[str, float]], top: int | None) -> DataFrame:
    frame = SparkSession.active().createDataFrame(pairs, "feature string, importance double")
    frame = frame.orderBy(F.desc("importance"), "feature")
    return frame if top is None else frame.limit(top)


def _metric(df: DataFrame, task: str) -> float:
    """Unrounded R2 or ROC AUC of ``output`` against ``label``."""
    if task_of(task).classification:
        return roc_auc(df, "label", "output", digits=9).first()["roc_auc"]
    return regression_metrics(df, "label", "output", digits=9).first()["r2"]


def shuffled_column(rows: DataFrame, column: str, seed: int, places: DataFrame | None = None) -> DataFrame:
    """``rows`` with the values of one column dealt out in hash order.

    Row i in id order gets the value of row i in hash order: two range-placed numberings
    and one join on the number, so no task sees the whole column. ``places``: ``rows`` with
    their number in id order as ``_nth``, if known.
    """
    if places is None:
        places = number_rows(rows, [("facility_id", "asc")], [], out="_nth")
    drawn = rows.select(
        "facility_id", F.col(column), F.xxhash64(F.col("facility_id"), F.lit(column), F.lit(seed)).alias("_hash")
    )
    values = number_rows(drawn, [("_hash", "asc")], ["facility_id"], out="_nth").select("_nth", column)
    return places.drop(column).join(values, "_nth").drop("_nth")


def permutation_importance(
    model: PipelineModel, rows: DataFrame, task: str, seed: int = 42, columns: Sequence[str] | None = None
) -> DataFrame:
    """Metric lost per shuffled input column, over all ``rows``.

    The rows as they are and those with each column shuffled are scored by one ``transform``.
    """
    wanted = list(columns if columns is not None else (*CATEGORICAL, *task_of(task).numeric))
    places = number_rows(rows, [("facility_id", "asc")], [], out="_nth")
    tables = [rows, *[shuffled_column(places.drop("_nth"), c, seed, places) for c in wanted]]
    together = reduce(DataFrame.unionByName, [t.withColumn("_table", F.lit(k)) for k, t in enumerate(tables)])
    outputs = materialize(_output(model, together, task).select("_table", "label", "output"), "outputs")
    base, *lost = [_metric(outputs.where(F.col("_table") == k), task) for k in range(len(tables))]
    return _small_frame([(c, round(base - x, 6)) for c, x in zip(wanted, lost)], len(wanted))


def hash_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows first in hash order of their id: the same sample on every run."""
    return rows.orderBy(F.xxhash64(F.col("facility_id"), F.lit(seed)), "facility_id").limit(n)


def shapley_rows(
    model: PipelineModel, rows: DataFrame, task: str, n: int | None = None, orders: int = 8, seed: int = 42
) -> DataFrame:
    """Contribution of every input column to every row: (facility_id, feature, contribution).

    ``n`` restricts the rows to a sample of that size. For each row and each of ``orders``
    random column orders, one other row is the starting point; columns switch to the row's own values one after another,
    and the change in model output is credited to the column that switched. The
    contributions of a row add up to its output minus the mean output of its starting rows.

    A row is prepared and coded once, a number for each input column. It meets the groups of trees with the codes of its
    starting rows and its orders; mixed rows exist inside the tasks only, and a task gives one number for each row and column.
    """
    columns = [*CATEGORICAL, *task_of(task).numeric]
    prepared, forest = model.stages
    codes = Codes.of(feature_columns(prepared), columns, forest.cuts)
    sample = rows if n is None else hash_sample(rows, n, seed)
    own = StructType([rows.schema["facility_id"], StructField("own", BinaryType())])
    coded = prepared.transform(sample).select("facility_id", vector_to_array("features").alias("x")).mapInArrow(codes.encode, own)
    coded = number_rows(coded, [("facility_id", "asc")], [], out="nth").withColumn("nth", F.col("nth") - 1)
    size = coded.count()
    start = coded.select(F.col("nth").alias("start_nth"), F.col("own").alias("start"))
    draws = F.sequence(F.lit(1), F.lit(orders))
    drawn = coded.select("nth", "facility_id", F.explode(draws).alias("draw")).select(
        "nth", "draw", F.pmod(F.xxhash64("facility_id", "draw", F.lit(seed)), F.lit(size)).alias("start_nth")
    )
    starts = drawn.join(start, "start_nth").groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("draw", "start"))).alias("starts"))

    def order(draw: Column) -> Column:
        """Places of the columns in a draw's order: columns sorted by a hash of (row, draw, column)."""
        keyed = [F.struct(F.xxhash64(F.col("facility_id"), draw, F.lit(c), F.lit(seed)), F.lit(c).alias("c"), F.lit(k).alias("k")) for k, c in enumerate(columns)]
        return F.transform(F.array_sort(F.array(*keyed)), lambda x: x["k"].cast("int"))

    paired = coded.join(starts, "nth").select(
        F.monotonically_increasing_id().alias("_row"), "facility_id", "own",
        F.transform("starts", lambda x: x["start"]).alias("starts"), F.flatten(F.transform(draws, order)).alias("orders"),
    )
    paired = materialize(paired, "walks")
    blocks = paired.select("_row", "own", "starts", "orders").mapInArrow(lambda batches: pack_walks(batches, orders, len(columns)), "first long, bins binary")
    output = 1 if forest.classes else 0
    credit = forest.votes(blocks, size, lambda trees, block: walked(trees, block, codes, orders, output), len(columns), WALK_GROUPS)
    shares = paired.select("_row", "facility_id").join(credit, "_row").groupBy("facility_id").agg(
        *[(F.avg(F.col("_votes")[k]) / forest.getNumTrees).alias(f"_{k}") for k in range(len(columns))]
    )
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{k}").alias("contribution")) for k, c in enumerate(columns)])
    return shares.select("facility_id", F.inline(named))


@dataclass(frozen=True)
class Codes:
    """One number for the value of a row in each input column: the bin of a number, or the slot of a level from 1 on, 0 for none."""

    spans: list[tuple[int, int]]  # features of each column
    category: list[bool]
    cuts: list[np.ndarray]

    @classmethod
    def of(cls, column_of: Sequence[str], columns: Sequence[str], cuts: Sequence[Sequence[float]]) -> Codes:
        """``column_of``: input column of every feature; the features of a column lie side by side."""
        spans = [(column_of.index(c), column_of.index(c) + column_of.count(c)) if c in column_of else (0, 0) for c in columns]
        return cls(spans, [c in CATEGORICAL for c in columns], [np.array(c) for c in cuts])

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``facility_id, x`` to ``facility_id, own``."""
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = np.zeros((len(x), len(self.spans)), np.uint16)
            bins = to_bins(x, self.cuts)
            for k, ((a, b), category) in enumerate(zip(self.spans, self.category)):
                if category and b > a:
                    on = x[:, a:b] != 0
                    out[:, k] = np.where(on.any(axis=1), on.argmax(axis=1) + 1, 0)
                elif b > a:
                    out[:, k] = bins[:, a]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in out], pa.binary())], names=["facility_id", "own"])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Bins of the features."""
        width = len(self.cuts)
        off, on = (to_bins(np.full((1, width), v), self.cuts)[0] for v in (0.0, 1.0))
        out = np.repeat(off[None], len(codes), axis=0)
        for k, ((a, b), category) in enumerate(zip(self.spans, self.category)):
            if category:
                rows = np.flatnonzero(codes[:, k])
                at = a + codes[rows, k].astype(np.intp) - 1
                out[rows, at] = on[at]
            elif b > a:
                out[:, a] = codes[:, k]
        return out


def pack_walks(batches: Iterator[pa.RecordBatch], orders: int, columns: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows with consecutive numbers: ``first`` and the codes, starts and orders of the rows, compressed."""
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = batch.column(0).to_numpy()
        own, starts = (np.frombuffer(b"".join(c.to_pylist()), np.uint16) for c in (batch.column(1), batch.column(2).flatten()))
        own, starts = own.reshape(-1, columns), starts.reshape(-1, orders, columns)
        order = batch.column(3).flatten().to_numpy().astype(np.uint8).reshape(-1, orders, columns)
        jumps = (np.flatnonzero(np.diff(numbers) != 1) + 1).tolist()
        for a, end in zip([0, *jumps], [*jumps, len(numbers)]):
            for low in range(a, end, WALKS):
                part = slice(low, min(low + WALKS, end))
                plain = own[part].tobytes() + starts[part].tobytes() + order[part].tobytes()
                block = (part.stop - part.start).to_bytes(4, "little") + pa.compress(plain, "zstd", asbytes=True)
                yield pa.RecordBatch.from_pydict({"first": pa.array([numbers[low]], pa.int64()), "bins": pa.array([block], pa.binary())})


def walked(trees: Trees, block: bytes, codes: Codes, orders: int, output: int) -> np.ndarray:
    """(row, column): change of the trees' summed output as the column switches, on average over the draws.

    A step whose column has the same value in both rows leaves the output as it is, and the last mix is the row itself.
    """
    n, columns = int.from_bytes(block[:4], "little"), len(codes.spans)
    plain = np.frombuffer(pa.decompress(block[4:], n * columns * (2 + 3 * orders), "zstd"), np.uint8)
    a, b = 2 * n * columns, 2 * n * columns * (1 + orders)
    own = plain[:a].view(np.uint16).reshape(n, 1, columns)
    start = plain[a:b].view(np.uint16).reshape(n, orders, columns)
    order = plain[b:].reshape(n, orders, columns).astype(np.intp)
    place = np.argsort(order, axis=2)  # step at which each column switches, from 0
    scored = np.ones((n, orders, columns), bool)  # mixes after 0 to columns - 1 steps
    scored[:, :, 1:] = np.take_along_axis(own != start, order, axis=2)[:, :, :-1]
    steps = np.arange(columns)[:, None]
    mixed = np.where(place[:, :, None, :] < steps, own[:, :, None, :], start[:, :, None, :])[scored]
    found = trees.votes(codes.decode(np.concatenate([own[:, 0], mixed])))[:, output]
    path = np.empty((n, orders, columns + 1))
    path[:, :, :-1][scored] = found[n:]
    last = np.maximum.accumulate(np.where(scored, steps[:, 0], 0), axis=2)
    path[:, :, :-1] = np.take_along_axis(path, last, axis=2)
    path[:, :, -1] = found[:n, None]
    gain = np.empty((n, orders, columns))
    np.put_along_axis(gain, order, np.diff(path, axis=2), axis=2)
    return gain.mean(axis=1)


def explain(
    model: PipelineModel, rows: DataFrame, task: str, n: int | None = None, top: int | None = None, orders: int = 8, seed: int = 42
) -> DataFrame:
    """Columns by mean absolute contribution over all rows (or a sample of ``n``), largest first."""
    per_row = shapley_rows(model, rows, task, n, orders, seed)
    board = (
        per_row.groupBy("feature")
        .agg(
            half_even(F.avg(F.abs("contribution")), 6).alias("mean_abs_contribution"),
            half_even(F.avg("contribution"), 6).alias("mean_contribution"),
        )
        .orderBy(F.desc("mean_abs_contribution"), "feature")
    )
    return board if top is None else board.limit(top)

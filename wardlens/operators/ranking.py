"""Exact row numbers, ranks and tiles without moving a whole group to one task.

A plain window with no partition key sorts every row in one task, and a window
over a hot key does the same for that key. Here rows are placed by one range
shuffle over (group, order, tie-break). The tie-break is part of the range key,
so a value held by a third of the rows is split like any other. The placement is
written once; counts per partition then give each row its global position.

Ranks and positions inside a group need the position of the first row with the same
key. It is found inside each sorted partition as the rows are written; a key that
reaches over a partition border takes its start from the partition before. So
nothing is joined on a value or group, however many rows share it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from wardlens.sources.scratch import materialize

Order = tuple[str, str]  # (column, "asc" | "desc")

_INDEX_BITS = 33  # monotonically_increasing_id: partition above, row index below


def _sort_key(order: Order) -> Column:
    name, way = order
    return F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_first()


def join_null_safe(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which NULL equals NULL. Adaptive execution picks the strategy by the sides'
    real sizes and splits hot keys."""
    renamed = small.select(
        *[F.col(c).alias(f"_j_{c}") for c in on], *[c for c in small.columns if c not in on]
    )
    match = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in on]
    joined = big.join(renamed, match, "inner")
    return joined.drop(*[f"_j_{c}" for c in on])


def sort_rows(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Global sort that also splits rows with equal keys over tasks.

    The input is written first, and a row's place in that table is the last sort key: a name
    shared by a third of the rows does not end in one range partition, and a task that runs
    again gives its rows the same places.
    """
    df = materialize(df, "sorted")
    return df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*keys, "_tie").drop("_tie")


def place_rows(df: DataFrame, keys: Sequence[Column]) -> tuple[DataFrame, int]:
    """Rows with their 1-based global position ``_pos`` in the order ``keys``, and their number
    (from the footers of the written table). The input is written before it is numbered.

    Rows with equal keys are in no certain order among themselves, and may lie in several partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = [*keys, F.col("_tie")]
    df = materialize(df, "unplaced")  # a scan numbers its rows alike whenever a task runs again
    placed = materialize(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *spread)
        .sortWithinPartitions(*spread)
        .drop("_tie")
        .withColumn("_id", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftright("_id", _INDEX_BITS)
    index = F.col("_id").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    # One row per shuffle partition, so the single-task window and the broadcast are bounded.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    positioned = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("_pos", F.col("_before") + index + 1)
        .drop("_part", "_before", "_id")
    )
    return positioned, placed.count()


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two arrays differ, by the rules of grouping: null equals null and NaN equals NaN."""
    other = pc.fill_null(pc.not_equal(a, b), False)
    if pa.types.is_floating(a.type):
        both = pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))
        other = pc.and_not(other, both)
    return pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _mark_runs(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to the rows of a partition sorted by ``keys``: ``_first``, the index of the first row with
    the same keys, and ``_edge``, true for the first and the last row. Holds one batch back."""

    def closed(held: tuple[pa.RecordBatch, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        batch, first, edge = held
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(edge)], [*batch.schema.names, "_first", "_edge"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tails, start, at = None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            fresh = np.zeros(batch.num_rows, dtype=bool)
            fresh[0] = held is None
            for k, column in enumerate(columns):
                if tails:
                    fresh |= _differs(column, pa.concat_arrays([tails[k], column[:-1]]))
                else:
                    fresh[1:] |= _differs(column[1:], column[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(at, at + batch.num_rows), start))
            edge = np.zeros(batch.num_rows, dtype=bool)
            if held:
                yield closed(held)
            else:
                edge[0] = True
            held, tails, start, at = (batch, first, edge), [c[-1:] for c in columns], int(first[-1]), at + batch.num_rows
        if held:
            held[2][-1] = True
            yield closed(held)

    return marked


def place_runs(df: DataFrame, order: Sequence[Order], runs: Sequence[str]) -> DataFrame:
    """Rows with their 1-based global position ``_pos`` by ``order``, and ``_start``, the position of
    the first row with the same ``runs``, the leading columns of the order.

    After the placement nothing is shuffled but the two outer rows of each partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = [*[_sort_key(o) for o in order], F.col("_tie")]
    df = materialize(df, "unplaced")
    marks = StructType([*df.schema.fields]).add("_first", LongType()).add("_edge", BooleanType())
    placed = materialize(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *spread)
        .sortWithinPartitions(*spread)
        .drop("_tie")
        .mapInArrow(_mark_runs(runs), marks)
        .withColumn("_id", F.monotonically_increasing_id()),
        "placed",
    )
    part = F.shiftright("_id", _INDEX_BITS)
    index = F.col("_id").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    key = F.struct(*runs)
    # At most two rows per shuffle partition, so the single-task windows and the broadcast are bounded.
    in_order = Window.orderBy("_part")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        placed.filter("_edge")
        .groupBy(part.alias("_part"))
        .agg(
            (F.max(index) + 1).alias("_rows"), F.max("_first").alias("_open"),
            F.min_by(key, "_id").alias("_head"), F.max_by(key, "_id").alias("_foot"),
        )
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
                "_goes_on": F.coalesce(F.col("_head").eqNullSafe(F.lag("_foot").over(in_order)), F.lit(False)),
            }
        )
        # Start of the last key of each partition: its own, or that of the partition before if one key fills it.
        .withColumn("_own", F.when(~F.col("_goes_on") | (F.col("_open") > 0), F.col("_before") + F.col("_open") + 1))
        .withColumn("_last_start", F.last("_own", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("_part", "_before", F.when(F.col("_goes_on"), F.lag("_last_start").over(in_order)).alias("_carried"))
    )
    from_before = (F.col("_first") == 0) & F.col("_carried").isNotNull()
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(borders), "_part")
        .withColumn("_pos", F.col("_before") + index + 1)
        .withColumn("_start", F.when(from_before, F.col("_carried")).otherwise(F.col("_before") + F.col("_first") + 1))
        .drop("_part", "_before", "_carried", "_first", "_edge", "_id")
    )


def number_rows(
    df: DataFrame,
    by: Sequence[Order],
    tie: Sequence[str],
    within: Sequence[str] = (),
    out: str = "row_number",
) -> DataFrame:
    """``row_number() over (partition by within order by by, tie)``."""
    order = [*[(c, "asc") for c in within], *by, *[(c, "asc") for c in tie]]
    if not within:
        return place_rows(df, [_sort_key(o) for o in order])[0].withColumnRenamed("_pos", out)
    placed = place_runs(df, order, list(within))
    return placed.withColumn(out, F.col("_pos") - F.col("_start") + 1).drop("_pos", "_start")


def rank_rows(df: DataFrame, by: Sequence[Order], tie: Sequence[str], out: str = "rank") -> DataFrame:
    """``rank() over (order by by)``: ties share the lowest position, gaps follow.

    ``tie`` only spreads equal rows over tasks; it does not change the rank.
    """
    placed = place_runs(df, [*by, *[(c, "asc") for c in tie]], [c for c, _ in by])
    return placed.drop("_pos").withColumnRenamed("_start", out)


def running_total(df: DataFrame, by: Sequence[Order], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before this one; ``by`` holds distinct keys.

    The frame is range-placed and written: totals per partition are added up, and the window
    runs inside each partition.
    """
    keys = [_sort_key(o) for o in by]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "totals")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum(value).alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_ahead"))
    )
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_ahead") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_ahead")
    )


def rank_by_value(df: DataFrame, key: str, way: str = "desc", out: str = "rank") -> DataFrame:
    """``rank() over (order by key)`` for a key with few distinct values (a small count, a 3-digit share).

    Rows are counted per value and the counts added up in value order, so no row is
    sorted or moved; the ranks come back by a join on the value.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    ranks = running_total(counts, [(key, way)], "_rows", "_before")
    return join_null_safe(df, ranks.select(key, (F.col("_before") + 1).alias(out)), [key])


def ntile_rows(df: DataFrame, tiles: int, by: Sequence[Order], tie: Sequence[str], out: str = "tile") -> DataFrame:
    """``ntile(tiles) over (order by by, tie)``: sizes differ by at most one, larger first."""
    order = [*by, *[(c, "asc") for c in tie]]
    placed, total = place_rows(df, [_sort_key(o) for o in order])
    return placed.withColumn(out, tile_of("_pos", total, tiles)).drop("_pos")


def tile_of(position: str, total: int, tiles: int) -> Column:
    """Tile of a 1-based position among ``total`` rows."""
    size, larger = divmod(total, tiles)
    head = larger * (size + 1)
    pos = F.col(position)
    in_head = F.floor((pos - 1) / F.lit(size + 1)) + 1
    in_tail = F.floor((pos - 1 - head) / F.lit(max(size, 1))) + 1 + larger
    return F.when(pos <= head, in_head).otherwise(in_tail).cast("long")


def top_n_within(df: DataFrame, within: Sequence[str | Column], order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """First ``n`` rows per group. Catalyst cuts each map task to ``n`` rows per
    group before the shuffle (WindowGroupLimit), so a hot group sends few rows."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)

"""Hold-out split and contiguous folds, the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.operators.ranking import number_rows

TEST_SHARE, SEED, FOLDS = 0.2, 42, 5


def _case(column: str, values: dict[float, Column | int]) -> Column:
    """Lookup of a class value in a small dict."""
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(F.col(column) == key, F.lit(value) if isinstance(value, int) else value).otherwise(out)
    return out


def quotas(counts: dict[float, int], total: int) -> dict[float, int]:
    """Share ``total`` out over classes in proportion; largest remainders get the rest."""
    rows = sum(counts.values())
    exact = {c: n * total / rows for c, n in counts.items()}
    taken = {c: int(x) for c, x in exact.items()}
    left = total - sum(taken.values())
    for c in sorted(exact, key=lambda c: (taken[c] - exact[c], c))[:left]:
        taken[c] += 1
    return taken


def hold_out(
    df: DataFrame, test: float = TEST_SHARE, seed: int = SEED, stratify: bool = False, row_id: str = "facility_id"
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``ceil(test * n)`` test rows, per-class shares kept if asked.

    Rows are drawn in hash order of their id, so the draw does not depend on partitions.
    """
    drawn = df.withColumn("_hash", F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}"))))
    within = ["label"] if stratify else []
    numbered = number_rows(drawn, [("_hash", "asc")], [row_id], within, "_nth").drop("_hash")
    if stratify:
        counts = {r["label"]: r["count"] for r in numbered.groupBy("label").count().collect()}
        quota = _case("label", quotas(counts, _ceil_share(sum(counts.values()), test)))
    else:
        quota = F.lit(_ceil_share(numbered.count(), test))
    return (
        numbered.filter(F.col("_nth") > quota).drop("_nth"),
        numbered.filter(F.col("_nth") <= quota).drop("_nth"),
    )


def _ceil_share(n: int, share: float) -> int:
    whole = int(n * share)
    return whole if whole == n * share else whole + 1


def stratified_fold_sizes(first_seen: list[float], counts: dict[float, int], k: int) -> dict[float, list[int]]:
    """Rows of each class per fold: classes laid end to end, every k-th place counted for a fold."""
    sizes, start = {}, 0
    for c in first_seen:
        end = start + counts[c]
        sizes[c] = [len(range(start + (i - start) % k, end, k)) for i in range(k)]
        start = end
    return sizes


def contiguous_folds(
    df: DataFrame, k: int = FOLDS, stratify: bool = False, order: str = "facility_id", out: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 by blocks of rows in order; with ``stratify`` by blocks inside each class."""
    numbered = number_rows(df, [(order, "asc")], [], ["label"] if stratify else [], "_nth")
    if not stratify:
        n = numbered.count()
        sizes = {None: [n // k + (1 if i < n % k else 0) for i in range(k)]}
    else:
        seen = numbered.groupBy("label").agg(F.count("*").alias("n"), F.min(order).alias("first")).collect()
        first_seen = [r["label"] for r in sorted(seen, key=lambda r: r["first"])]
        sizes = stratified_fold_sizes(first_seen, {r["label"]: r["n"] for r in seen}, k)

    def fold_of(blocks: list[int]) -> Column:
        ends = [sum(blocks[: i + 1]) for i in range(k)]
        col = F.lit(k - 1)
        for i in range(k - 2, -1, -1):
            col = F.when(F.col("_nth") <= ends[i], i).otherwise(col)
        return col

    fold = fold_of(sizes[None]) if not stratify else _case("label", {c: fold_of(b) for c, b in sizes.items()})
    return numbered.withColumn(out, fold.cast("int")).drop("_nth")

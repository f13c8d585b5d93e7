"""Quantile bins of features, shared by boosters and forests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 255
MISSING = BINS  # bin of missing values


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of cut points below it."""
    out = np.empty(x.shape, np.uint8)
    for k, c in enumerate(cuts):
        out[:, k] = np.where(np.isnan(x[:, k]), MISSING, np.searchsorted(c, x[:, k], "left"))
    return out


def quantile_cuts(df: DataFrame, width: int, by: str) -> dict[object, list[np.ndarray]]:
    """Cut points of every feature for each model, from one pass of quantile sketches."""
    shares = F.lit(np.array([(k + 1) / BINS for k in range(BINS - 1)]))  # one literal, made once: a list becomes as many of them for each feature
    values = [F.nanvl(F.col("x")[k], F.lit(None).cast("double")) for k in range(width)]
    sketch = [F.percentile_approx(v, shares, 100_000).alias(f"q{k}") for k, v in enumerate(values)]
    rows = df.groupBy(by).agg(*sketch).collect()  # one row per model
    return {r[by]: [np.unique(np.array(r[f"q{k}"] if r[f"q{k}"] is not None else [], float)) for k in range(width)] for r in rows}

"""Feature preparation as built-in ML stages, fitted on training rows only.

Categories: levels seen in fewer than ``min_rows`` training rows share one slot, levels
never seen get no slot (all zeros). Numbers: exact median for missing, then standardised
by mean and population deviation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.models.columns import CATEGORICAL
from wardlens.operators.medians import exact_medians

MIN_ROWS = 25
POOLED = "other"
UNKNOWN = "(missing)"


def _select_also(*items: str) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {', '.join(items)} FROM __THIS__")


def _level_stage() -> SQLTransformer:
    return _select_also(*[f"coalesce({c}, '{UNKNOWN}') AS {c}_level" for c in CATEGORICAL])


def _impute_stage(medians: dict[str, float]) -> SQLTransformer:
    return _select_also(*[f"coalesce(CAST({c} AS DOUBLE), {m!r}D) AS {c}_full" for c, m in medians.items()])


def _scale_stage(moments: dict[str, tuple[float, float]]) -> SQLTransformer:
    """A column without spread is only centred."""
    return _select_also(*[f"({c}_full - ({m!r}D)) / {sd or 1.0!r}D AS {c}_scaled" for c, (m, sd) in moments.items()])


def _pool_stage(frequent: dict[str, int], levels: dict[str, int]) -> SQLTransformer:
    """Index to slot. Indices run by falling frequency, so the rare levels are the tail."""
    slots = [
        f"CASE WHEN {c}_index < {frequent[c]} THEN {c}_index WHEN {c}_index < {levels[c]}"
        f" THEN {frequent[c]}D ELSE {levels[c] + 1}D END AS {c}_slot"
        for c in CATEGORICAL
    ]
    return _select_also(*slots)


class Preprocessor(Estimator):
    """Estimator whose fitted form is a PipelineModel of built-in stages (so it can be stored)."""

    def __init__(self, numeric: Sequence[str], min_rows: int = MIN_ROWS):
        super().__init__()
        self.numeric, self.min_rows = tuple(numeric), min_rows

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        df, stages = dataset, []

        def add(stage: Estimator | Transformer) -> Transformer:
            nonlocal df
            fitted = stage.fit(df) if isinstance(stage, Estimator) else stage
            df = fitted.transform(df)
            stages.append(fitted)
            return fitted

        add(_level_stage())
        index = add(
            StringIndexer(
                inputCols=[f"{c}_level" for c in CATEGORICAL], outputCols=[f"{c}_index" for c in CATEGORICAL],
                handleInvalid="keep", stringOrderType="frequencyDesc",
            )
        )
        levels = {c: len(labels) for c, labels in zip(CATEGORICAL, index.labelsArray)}
        add(_pool_stage(self._frequent(df), levels))
        add(
            OneHotEncoder(
                inputCols=[f"{c}_slot" for c in CATEGORICAL], outputCols=[f"{c}_vec" for c in CATEGORICAL],
                handleInvalid="keep", dropLast=True,
            )
        )
        parts = [f"{c}_vec" for c in CATEGORICAL]
        # A number column with no value at all has no median and is left out.
        found = {r["column_name"]: r["median"] for r in exact_medians(dataset, self.numeric).collect()}
        medians = {c: found[c] for c in self.numeric if c in found}
        if medians:
            add(_impute_stage(medians))
            sums = df.agg(
                *[F.avg(f"{c}_full").alias(f"{c}_mean") for c in medians],
                *[F.stddev_pop(f"{c}_full").alias(f"{c}_sd") for c in medians],
            ).first()
            add(_scale_stage({c: (sums[f"{c}_mean"], sums[f"{c}_sd"]) for c in medians}))
            parts += [f"{c}_scaled" for c in medians]
        add(VectorAssembler(inputCols=parts, outputCol="features"))
        return PipelineModel(stages)

    def _frequent(self, df: DataFrame) -> dict[str, int]:
        """Number of levels per category with at least ``min_rows`` rows, in one pass."""
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{c}_level").alias("level")) for c in CATEGORICAL])
        seen = df.select(F.inline(pairs)).groupBy("c", "level").agg(F.count("*").alias("n"))
        found = seen.groupBy("c").agg(F.count_if(F.col("n") >= self.min_rows).alias("k")).collect()
        return {r["c"]: r["k"] for r in found}


def feature_names(model: PipelineModel) -> list[str]:
    """Name of every position of the feature vector of a fitted preprocessor."""
    index = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    names: list[str] = []
    for c, labels, frequent in zip(CATEGORICAL, index.labelsArray, _frequent_slots(model)):
        names += [f"{c}_{label}" for label in labels[:frequent]]
        if frequent < len(labels):
            names.append(f"{c}_{POOLED}")
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return names + [c.removesuffix("_scaled") for c in assembler.getInputCols() if c.endswith("_scaled")]


def feature_columns(model: PipelineModel) -> list[str]:
    """Input column of every position of the feature vector of a fitted preprocessor."""
    numbers = next(s for s in model.stages if isinstance(s, VectorAssembler)).getInputCols()[len(CATEGORICAL) :]
    return [c for c, n in zip(CATEGORICAL, _slots(model)) for _ in range(n)] + [c.removesuffix("_scaled") for c in numbers]


def _slots(model: PipelineModel) -> list[int]:
    """Number of slots of every category."""
    index = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    return [k + (k < len(labels)) for k, labels in zip(_frequent_slots(model), index.labelsArray)]


def _frequent_slots(model: PipelineModel) -> list[int]:
    """Number of levels with a slot of their own, for every category."""
    pool = next(s for s in model.stages if isinstance(s, SQLTransformer) and "_slot" in s.getStatement())
    return [int(re.search(rf"{c}_index < (\d+) THEN {c}_index", pool.getStatement()).group(1)) for c in CATEGORICAL]

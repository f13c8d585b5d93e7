"""Intermediate tables of this package, below the folder named in ``spark.checkpoint.dir``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.sources.scratch import materialize, scratch_path

__all__ = ["materialize", "scratch_path", "unique_documents", "without"]


def without(docs: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` are not a row of ``gone``, null equal to null, columns as they are.

    The columns of ``gone`` get names that ``docs`` does not hold, whatever its columns are called.
    """
    taken, names = {c.lower() for c in docs.columns}, []
    for k in range(len(keys)):
        name = f"_gone_{k}"
        while name in taken:
            name = f"_{name}"
        names.append(name)
    gone = gone.toDF(*names).distinct()
    return docs.join(gone, reduce(Column.__and__, [k.eqNullSafe(gone[n]) for k, n in zip(keys, names)]), "left_anti")


def unique_documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(one row ``doc_id, text`` per id with a null text made empty, the rows without id).

    Rows that share an id count as one document with the greatest of their texts. Ids alone
    are read to find out whether there are such rows; only those are regrouped.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    twice = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        again = known.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        known = known.join(twice, "doc_id", "left_anti").unionByName(again)
    return known, rows.where("doc_id IS NULL")

"""Mixing sources to target weights over a domain-language-source tree (operator 1, native).

The budget of tokens is passed down the tree. At each node it is shared among the children by
weight; a child whose whole subtree holds less than its share (its tokens times the greatest
number of epochs) takes what it has, and the shortage goes to its siblings by weight before
anything is left to the parent's own siblings. As a node never gets more than its subtree holds,
one closed form per set of siblings, from the leaves' totals, settles this.

A leaf with quota q and s tokens is read q / s whole times; the rest is the longest prefix of
whole documents, within the rest of tokens, of the next epoch. Each epoch has an order of its own, by a hash of seed,
epoch and document. The prefix is found from totals per hash bucket; only the bucket in which
the rest runs out is put in order row by row. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.tables import materialize

SPACE = r"\x20\x09-\x0D"
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of words of a text; none if it is null."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")).cast("long")


def _weights(nodes: DataFrame, name: str, weights: dict[str, float]) -> Column:
    """Weight of each node by its own name, 1 where none is given."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(f"={k}"), F.lit(float(v)))])
    return F.coalesce(F.element_at(table, F.col(name)), F.lit(1.0))


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Share ``budget`` among the siblings below ``parents``: columns ``weight, capacity, budget`` become ``quota``."""
    by_ratio = Window.partitionBy(*parents).orderBy("ratio", name)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    nodes = nodes.withColumn("_taken", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    nodes = nodes.withColumn("_rest", F.sum("weight").over(from_here))
    level = F.when(F.col("_rest") > 0, (F.col("budget") - F.col("_taken")) / F.col("_rest")).otherwise(F.lit(0.0))
    nodes = nodes.withColumn("_full", (level >= F.col("ratio")) & (F.col("weight") > 0))
    whole = Window.partitionBy(*parents)
    filled = F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
    nodes = nodes.withColumn("_left", F.col("budget") - filled).withColumn("_open", open_weight)
    part = F.when(F.col("_open") > 0, F.floor(F.col("_left") * F.col("weight") / F.col("_open"))).otherwise(F.lit(0))
    nodes = nodes.withColumn("quota", F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(part, F.col("capacity"))))
    # whole tokens lost by rounding go to the first open siblings by name
    lost = F.col("budget") - F.sum("quota").over(whole)
    room = ~F.col("_full") & (F.col("weight") > 0) & (F.col("quota") < F.col("capacity"))
    turn = F.sum(room.cast("int")).over(Window.partitionBy(*parents).orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    nodes = nodes.withColumn("_lost", lost).withColumn("_turn", turn).withColumn("_room", room)
    extra = (F.col("_room") & (F.col("_turn") <= F.col("_lost"))).cast("long")
    nodes = nodes.withColumn("quota", F.col("quota") + extra)
    return nodes.drop("ratio", "_taken", "_rest", "_full", "_left", "_open", "_lost", "_turn", "_room", "budget")


def quotas(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], share: float, epochs: int) -> DataFrame:
    """``leaves`` (levels, ``rows``, ``tokens``) with the token quota of each.

    The budget is ``share`` of all tokens, at most what ``epochs`` readings of all leaves with a
    weight above 0 on their whole path hold.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    for k, name in enumerate(levels):
        leaves = leaves.withColumn(f"_w{k}", _weights(leaves, name, weights.get(name, {})))
    usable = F.lit(True)
    for k in range(len(levels)):
        usable = usable & (F.col(f"_w{k}") > 0)
    leaves = leaves.withColumn("capacity", F.when(usable, F.col("capacity")).otherwise(0))
    total = leaves.agg(
        F.least(F.floor(F.sum("tokens") * share), F.sum("capacity")).cast("long").alias("budget"), F.lit(0).alias("_root")
    )
    above, parents = total, ["_root"]
    leaves = leaves.withColumn("_root", F.lit(0))
    for k, name in enumerate(levels):
        keys = [*parents, name]
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.max(f"_w{k}").alias("weight"))
        nodes = _fill(nodes.join(above, parents), parents, name)
        above, parents = nodes.select(*keys, F.col("quota").alias("budget")), keys
    return leaves.select(*levels, "_root", "rows", "tokens").join(above, parents).drop("_root").withColumnRenamed("budget", "quota")


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, dict[str, float]],
    share: float,
    epochs: int = 4,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, copies`` of the rows that are read at least once.

    ``weights`` maps the level names ``domain``, ``lang`` and ``source`` to weights by node name; nodes
    not named weigh 1. Tokens are words; a null text has none and is read with its leaf's whole
    epochs and prefix. A null domain, language or source is a node of its own. Repeated rows are
    rows of their own, in an order of text. Other columns are not read; an empty table gives an
    empty one.
    """
    levels = ["domain", "lang", "source"]
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *(name(c).alias(a) for c, a in zip((domain, F.col(lang_col), F.col(source_col)), levels, strict=True)),
        word_count(F.col(text_col)).alias("n_tokens"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )
    rows = materialize(rows, "mix-rows")
    leaves = rows.groupBy(*levels).agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    plan = materialize(quotas(leaves, levels, weights, share, epochs), "mix-quotas")
    largest = plan.agg(F.max("rows")).first()[0] or 0
    digits = 1
    while largest > bucket_rows * 16**digits:
        digits += 1
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("long"))
    plan = plan.withColumn("rest", F.col("quota") - F.col("whole") * F.col("tokens")).select(*levels, "whole", "rest")
    order = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("whole").cast("string"), F.col("doc_id").cast("string")))
    rows = rows.join(plan, levels).withColumn("place", order).withColumn("bucket", F.substring("place", 1, digits))
    key = [*levels, "bucket"]
    sums = rows.groupBy(*key).agg(F.sum("n_tokens").alias("_sum"))
    upto = Window.partitionBy(*levels).orderBy("bucket")
    sums = sums.withColumn("_upto", F.sum("_sum").over(upto)).withColumn("_before", F.col("_upto") - F.col("_sum"))
    rows = rows.join(sums.select(*key, "_upto", "_before"), key)
    certain = rows.where(F.col("_upto") <= F.col("rest")).withColumn("more", F.lit(1))
    beyond = rows.where((F.col("_upto") > F.col("rest")) & (F.col("_before") > F.col("rest"))).withColumn("more", F.lit(0))
    inner = Window.partitionBy(*key).orderBy("place", "n_tokens", "tie").rowsBetween(Window.unboundedPreceding, 0)
    partial = rows.where((F.col("_upto") > F.col("rest")) & (F.col("_before") <= F.col("rest")))
    reached = F.col("_before") + F.sum("n_tokens").over(inner)
    partial = partial.withColumn("more", (reached <= F.col("rest")).cast("int"))
    out = certain.unionByName(beyond).unionByName(partial)
    out = out.withColumn("copies", F.col("whole") + F.col("more")).where("copies > 0")
    plain = lambda c: F.when(F.col(c) != "-", F.substring(c, 2, 1 << 30)).alias(c)
    return out.select("doc_id", *(plain(c) for c in levels), "n_tokens", "copies")

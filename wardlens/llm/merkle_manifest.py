"""Merkle manifest of a table, with inclusion proofs by pointer jumping.

Rows are the leaves of one tree per language; the trees' roots (``subroot``), in the order of the
languages, are the leaves of a top tree whose root names the whole table. A parent is the SHA-256
of the hex digests of up to FANOUT consecutive nodes.

* Leaves get their place by one range shuffle (``place_rows``), so a language with most rows is spread.
* A level is one grouping of the level below, an eighth of its size; groups hold at most FANOUT rows.
* Every node but a root starts with a pointer to its parent and the siblings beside it. A round joins
  the table of pointers to itself: pointers double their distance, and the sibling segments are put
  end to end. After log2(depth) rounds all reach the root. Leaves of one run share their run's
  pointer, so segments are carried once per FANOUT leaves.
* In a round over distance d up to FANOUT**d rows wait for one ancestor. Beyond distance FREE each
  ancestor is copied FANOUT**(d - FREE) times and rows go by their place modulo that number. At most
  FANOUT**FREE rows share a key then, and the copies number no more than the ancestors at distance FREE + 1 below.

Rows without language form a tree of their own, first in order. Rows with equal or null ids are leaves
too (null ids first, then by leaf). An empty table gives an empty manifest. Other columns of the
input play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.tables import materialize
from wardlens.operators.ranking import place_rows

FANOUT = 8
FREE = 3
TOP = ""  # name of the top tree; the others are "-" (no language) and "=" + language
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODE = ["tree", "level", "pos"]
_STEPS = "array<struct<before: binary, after: binary>>"


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the columns: ``-`` for null, else byte count, ``:`` and value."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _parent(digests: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(digests, _hex), ""), 256))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tampered: Column | None = None) -> DataFrame:
    """``tree, doc_id, leaf, changed`` of every row; ``changed`` is the leaf after tampering, else null.

    ``tampered`` says which rows have the A-Z of their text made small. The columns of ``fields``
    are id, any others, and the text last; ``lang`` names the tree.
    """
    row = docs.select(*fields)
    values = [F.col(c) for c in fields]
    other = [*values[:-1], F.translate(values[-1], UPPER, LOWER)]
    changed = F.lit(None).cast("binary") if tampered is None else F.when(tampered, F.unhex(leaf_digest(other)))
    return row.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("tree"),
        F.col(fields[0]).alias("doc_id"),
        F.unhex(leaf_digest(values)).alias("leaf"),
        changed.alias("changed"),
    )


def _place_leaves(rows: DataFrame) -> tuple[DataFrame, int]:
    """(leaves with place ``pos`` from 0 in their tree and ``n`` leaves of the tree, size of the largest tree)."""
    placed, _ = place_rows(rows, [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    trees = materialize(placed.groupBy("tree").agg(F.min("_pos").alias("_first"), F.count("*").alias("n")), "trees")
    placed = placed.join(trees, "tree").withColumn("pos", F.col("_pos") - F.col("_first")).drop("_pos", "_first")
    return placed, trees.agg(F.max("n")).first()[0] or 0


def _level_above(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of FANOUT nodes of ``level``: their digests ``kids`` and their parent's ``digest``."""
    runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("run"))
    kids = F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"]
    return runs.agg(F.max("n").alias("n"), kids.alias("kids")).select(
        "tree", F.lit(level + 1).alias("level"), F.col("run").alias("pos"),
        F.ceil(F.col("n") / FANOUT).alias("n"), "kids", _parent(F.col("kids")).alias("digest"),
    )


def _grow(nodes: DataFrame, level: int, size: int) -> tuple[DataFrame, DataFrame, int]:
    """(tops: ``tree, level, pos, digest``; pointers of all nodes below a top; depth) of trees with ``nodes`` at ``level``.

    ``size`` bounds the nodes of a tree. Pointers name their target as ``to_level, to_pos``.
    """
    cols = [*_NODE, "n", "digest"]
    nodes = nodes.withColumn("level", F.lit(level)).select(*cols)
    tops, ups = nodes.where("n = 1"), []
    while size > 1:
        runs = materialize(_level_above(nodes, level), "runs")
        kid = F.posexplode("kids").alias("_i", "_digest")
        beside = [F.expr("slice(kids, 1, _i)"), F.expr(f"slice(kids, _i + 2, {FANOUT})")]
        joined = [F.coalesce(F.unhex(F.array_join(F.transform(b, F.hex), "")), F.lit(b"")) for b in beside]
        ups.append(
            runs.select("tree", "level", "pos", "kids", kid).select(
                "tree", F.lit(level).alias("level"), (F.col("pos") * FANOUT + F.col("_i")).alias("pos"),
                F.col("level").alias("to_level"), F.col("pos").alias("to_pos"),
                F.array(F.struct(joined[0].alias("before"), joined[1].alias("after"))).cast(_STEPS).alias("steps"),
            )
        )
        nodes, level, size = runs.select(*cols), level + 1, -(-size // FANOUT)
        tops = tops.unionByName(nodes.where("n = 1"))
    up = ups[0] if ups else tops.select(*_NODE, F.col("level").alias("to_level"), F.col("pos").alias("to_pos"), F.array().cast(_STEPS).alias("steps")).limit(0)
    for more in ups[1:]:
        up = up.unionByName(more)
    return tops.select(*_NODE, "digest"), up, len(ups)


def _jump(ended: DataFrame, open_: DataFrame, depth: int, lowest: int) -> DataFrame:
    """Pointers of all nodes to their root, as rows like ``ended``: ``tree, level, pos, steps, subroot, root``.

    ``ended`` holds the tops, whose steps lead to the root already; ``open_`` the pointers to parents
    of nodes at level ``lowest`` and above, at most ``depth`` levels below their top.
    """
    goal = [F.lit(None).cast("binary").alias(c) for c in ("subroot", "root")]
    end = [F.lit(None).cast("int").alias("to_level"), F.lit(None).cast("bigint").alias("to_pos")]
    pointers = open_.select("*", *goal).unionByName(ended.select("*", *end))
    distance = 1
    while distance <= depth:
        pointers = materialize(pointers, "pointers")
        copies = FANOUT ** max(0, distance - FREE)
        far = pointers.select(
            F.col("tree"), F.col("level").alias("to_level"), F.col("pos").alias("to_pos"), F.col("steps").alias("_steps"),
            F.col("subroot").alias("_subroot"), F.col("root").alias("_root"), F.col("to_level").alias("_to_level"), F.col("to_pos").alias("_to_pos"),
        )
        waiting = pointers.where("to_level IS NOT NULL").drop("subroot", "root")
        far = far.where(F.col("to_level") >= lowest + distance)  # no lower node is anyone's target
        key = ["tree", "to_level", "to_pos"]
        if copies > 1:
            far = far.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            waiting = waiting.withColumn("_copy", F.pmod(F.col("pos"), F.lit(copies)).cast("int"))
            key = [*key, "_copy"]
        moved = waiting.join(far, key).select(
            *_NODE, F.concat("steps", "_steps").alias("steps"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
            F.col("_to_level").alias("to_level"), F.col("_to_pos").alias("to_pos"),
        )
        pointers = pointers.where("to_level IS NULL").unionByName(moved)
        distance *= 2
    return pointers.where("to_level IS NULL").drop("to_level", "to_pos")


def manifest(rows: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``leaves()``.

    Digests are lower-case hex. ``folded_root`` is worked out from the changed leaf, where there is
    one, and the original siblings; ``verified`` tells whether it is the root.
    """
    placed, size = _place_leaves(rows)
    entry = F.struct("pos", "leaf", "changed", "doc_id")
    bottom = placed.groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("pos")).agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("kids")
    )
    bottom = materialize(bottom, "leaf-runs")
    single = F.col("n") == 1
    # Nodes that the runs of leaves stand for: their parents, or the leaf of a tree of one.
    level = F.when(single, F.lit(0)).otherwise(F.lit(1))
    digest = F.when(single, F.col("kids")[0]["leaf"]).otherwise(_parent(F.col("kids")["leaf"]))
    first = bottom.select("tree", level.alias("at"), "pos", F.ceil(F.col("n") / FANOUT).alias("n"), digest.alias("digest"))
    lone = first.where("at = 0").select("tree", F.lit(0).alias("level"), "pos", "digest")
    tops, up, depth = _grow(first.where("at = 1").drop("at"), 1, -(-size // FANOUT))
    tops = materialize(tops.unionByName(lone), "subroots")

    roots, trees = place_rows(tops.select("tree", "digest"), [F.col("tree")])
    roots = materialize(roots.select(F.col("tree").alias("_tree"), (F.col("_pos") - 1).alias("pos"), "digest"), "top-leaves")
    base = roots.select(F.lit(TOP).alias("tree"), "pos", F.lit(trees).cast("bigint").alias("n"), "digest")
    top, top_up, top_depth = _grow(base, 0, trees)
    nothing = F.array().cast(_STEPS).alias("steps")
    ended = top.select(*_NODE, nothing, F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    above = _jump(ended, top_up, top_depth, 0).where("level = 0").select("pos", "steps", "root")
    above = materialize(roots.join(above, "pos").select(F.col("_tree").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"), "top-paths")

    ended = tops.drop("digest").join(above, "tree").select(*_NODE, "steps", "subroot", "root")
    paths = _jump(ended, up, depth, 1)
    runs = bottom.withColumn("level", level).join(paths, _NODE)
    return _results(runs)


def _results(runs: DataFrame) -> DataFrame:
    """A row per leaf from its run, ``kids``, and the run's path, ``steps``."""
    runs = runs.select(
        "n", "kids", _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.transform(F.col("kids")["leaf"], _hex).alias("_leaf"),
        F.transform("steps", lambda s: F.struct(_hex(s["before"]).alias("before"), _hex(s["after"]).alias("after"))).alias("_steps"),
    )
    own = f"array(named_struct('before', array_join(slice(_leaf, 1, i), ''), 'after', array_join(slice(_leaf, i + 2, {FANOUT}), '')))"
    path = f"if(n > 1, concat({own}, _steps), _steps)"
    proofs = runs.select(
        "subroot", "root",
        F.expr(f"transform(kids, (k, i) -> named_struct('doc_id', k.doc_id, 'leaf', _leaf[i], 'start', coalesce(lower(hex(k.changed)), _leaf[i]), 'path', {path}))").alias("_rows"),
    )
    rows = proofs.select("subroot", "root", F.explode("_rows").alias("r")).select("subroot", "root", "r.*")
    folded = F.aggregate("path", F.col("start"), lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

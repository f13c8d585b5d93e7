"""Merkle manifest (op 12) against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wardlens.llm import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 8])) for k in range(0, len(last), 8)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return out


def reference(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        docs = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = docs, grow([leaf(r) for r in docs])
    top = grow([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        docs, levels = trees[lang]
        for at, r in enumerate(docs):
            steps = path(levels, at) + path(top, k)
            start = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                start = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            acc = leaf(start)
            for before, after in steps:
                acc = sha(before + acc + after)
            root = top[-1][0]
            out.append((r[0], levels[0][at], levels[-1][0], root, sha("".join(b + a for b, a in steps)), acc, acc == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "level", "pos", "leaf", "n", "_pos", "_id", "steps", "root"):
        docs = docs.withColumn(name, F.lit(3))
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle_manifest.manifest(merkle_manifest.leaves(docs.repartition(3), tampered=third))
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(n, langs):
    return [(k * 7 % 1009, f"src{k % 3}", langs(k), k, f"Text {k} ÄB\n" if k % 5 else "plain") for k in range(n)]


@pytest.mark.parametrize("free", [3, 0])
def test_deep_and_many_trees(spark, free, monkeypatch):
    """A hot language of five levels beside lone ones; with ``free`` 0 every ancestor is copied."""
    monkeypatch.setattr(merkle_manifest, "FREE", free)
    rows = rows_of(700, lambda k: "en" if k < 610 else f"x{k}" if k < 690 else None)
    assert run(spark, rows) == reference(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, "a", "en", 1, ""), (5, "a", "en", 2, "Same"), (5, "a", "en", 2, "Same"),
        (5, "b", "en", 2, "Other"), (6, "a", "", 2, "X" * 300_000), (3, "a", "é", 2, "İI"), (9, "a", "z", 2, None),
    ]
    rows += [(100 + k, "s", "en", 1, "AB") for k in range(59)]  # 64 leaves: the last run is full
    assert run(spark, rows) == reference(rows)
    assert run(spark, rows[:1]) == reference(rows[:1])


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    got = merkle_manifest.manifest(merkle_manifest.leaves(docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.count() == 0

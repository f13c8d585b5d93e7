"""Exact top-k search (op 11) against all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlens.llm import va_search

SCHEMA = "vec_id long, embedding array<float>"


def codes(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in v]


def reference(rows, k, every=50):
    known = {i: codes(v) for i, v in rows if i is not None and codes(v) is not None}
    out = []
    for q, a in known.items():
        if q % every:
            continue
        scored = [(-max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), 1 - 2**63), i) for i, b in known.items() if i != q and len(a) == len(b)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=50):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("dim", "n", "codes", "score", "rank", "query_id"):
        docs = docs.withColumn(name, F.lit("x"))
    return sorted(tuple(r) for r in va_search.search(docs.repartition(5), F.col("vec_id") % every == 0, k).collect())


def unit(rng, dim):
    v = rng.normal(size=dim)
    return [float(x) for x in v / np.linalg.norm(v)]


@pytest.mark.parametrize("group_bytes", [va_search.GROUP_BYTES, 1000])
def test_many_blocks_and_copies(spark, group_bytes, monkeypatch):
    """More vectors than a block, a third of them equal, a cluster of near copies, few and many query groups."""
    monkeypatch.setattr(va_search, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(11)
    hot, near = unit(rng, 9), np.array(unit(rng, 9))
    rows = [(k, unit(rng, 9)) for k in range(2500)]
    rows += [(k, hot) for k in range(2500, 3700)]
    rows += [(k, [float(x) for x in near + rng.normal(size=9) * 0.01]) for k in range(3700, 4200)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == reference(rows, 5)


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, unit(rng, 4)) for k in range(-60, 60)]
    rows += [(k, unit(rng, 3)) for k in range(100, 130)] + [(k, []) for k in range(150, 158)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(300 + k, [float(x) for x in rng.normal(size=4) * 10.0 ** (k % 30)]) for k in range(60)]  # far apart in size
    rows += [(400, [-0.0, 0.0, 0.0, 0.0]), (401, [0.0, 0.0, 0.0, 0.0]), (450, [0.5] * 7)]
    assert run(spark, rows, 3, 10) == reference(rows, 3, 10)


def test_repeated_ids(spark):
    rows = [(k, [float(k), 1.0]) for k in range(40)]
    again = rows + [(7, [7.0, 1.0])] * 5 + [(10, [10.0, 1.0])]
    assert run(spark, again, 4, 10) == reference(rows, 4, 10)
    other = run(spark, [*rows, (10, [99.0, 1.0])], 4, 10)
    assert len(other) == 16 and all(q != i for q, _, i, _ in other)


def test_empty_and_few(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0, 2.0])]) == []
    assert run(spark, [(50, [1.0, 2.0]), (3, [0.5, -2.0])]) == reference([(50, [1.0, 2.0]), (3, [0.5, -2.0])], 5)

"""Mixing (op 1) against a plain Python version of the rule."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardlens.llm import mixing


def share_out(budget, children):
    """Quota by child: full ones drop out until none is short."""
    quota, live = {}, dict(children)
    while True:
        weight = sum(w for w, _ in live.values())
        short = {k: c for k, (w, c) in live.items() if weight and w and (budget - sum(quota.values())) / weight >= c / w}
        if not short:
            break
        first = min(short, key=lambda k: (live[k][1] / live[k][0], k))
        quota[first] = live.pop(first)[1]
    left = budget - sum(quota.values())
    weight = sum(w for w, _ in live.values())
    for k, (w, c) in live.items():
        quota[k] = min(int(left * w // weight), c) if weight else 0
    lost = budget - sum(quota.values())
    for k in sorted(live):
        if lost > 0 and live[k][0] and quota[k] < live[k][1]:
            quota[k] += 1
            lost -= 1
    return quota


def reference(rows, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for i, text, dom, lang, src in rows:
        leaves[tuple("-" if x is None else f"={x}" for x in (dom, lang, src))].append((i, len((text or "").split())))
    names = ("domain", "lang", "source")
    weight = lambda k, n: float(weights.get(names[k], {}).get(n[1:], 1.0)) if n != "-" else 1.0
    total = {p: sum(n for _, n in d) for p, d in leaves.items()}
    cap = {p: total[p] * epochs if all(weight(k, x) > 0 for k, x in enumerate(p)) else 0 for p in leaves}
    budgets = {(): min(int(sum(total.values()) * share), sum(cap.values()))}
    for k in range(3):
        new = {}
        for parent, budget in budgets.items():
            children = {}
            for p in leaves:
                if p[:k] == parent:
                    w, c = children.get(p[k], (weight(k, p[k]), 0))
                    children[p[k]] = (w, c + cap[p])
            new.update({(*parent, n): q for n, q in share_out(budget, children).items()})
        budgets = new
    out = []
    for p, docs in leaves.items():
        q = budgets[p]
        whole = q // total[p] if total[p] else 0
        rest, used = q - whole * total[p], 0
        for i, n in sorted(docs, key=lambda d: hashlib.md5(f"{seed}|{whole}|{d[0]}".encode()).hexdigest()):
            used += n
            copies = whole + (used <= rest)
            if copies:
                out.append((i, n, copies))
    return sorted(out)


@pytest.mark.parametrize("share", [0.3, 0.9, 2.5, 50.0])
def test_mix(spark, share):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        src = rng.choice(["s0"] * 6 + [f"s{j}" for j in range(9)] + [None])
        dom = None if src is None else f"d{int(src[1:]) % 3}"
        rows.append((k, "w " * rng.choice([0, 3, 20, 70, 400]), dom, rng.choice(["en", "en", "de", None]), src))
    rows += [(1000, None, "d0", "en", "s0"), (1001, "x y", "only", "xx", "one"), (1002, "", "empty", "e", "e")]
    weights = {"domain": {"d0": 1, "d1": 5, "only": 3}, "lang": {"en": 2, "de": 0.5}, "source": {"s4": 0, "s1": 3}}
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    docs = docs.withColumn("quota", F.lit(1)).repartition(5)
    got = mixing.mix(docs, F.col("domain"), weights, share, seed=7, bucket_rows=3)
    assert sorted((r.doc_id, r.n_tokens, r.copies) for r in got.collect()) == reference(rows, weights, share, 4, 7)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", "x", "s"), (1, "a", None, None), (1, "a", None, None)], "doc_id long, text string, lang string, source string")
    assert mixing.mix(docs, F.lit("d"), {}, 1.0).count() == 3
    assert mixing.mix(docs.limit(0), F.lit("d"), {}, 1.0).count() == 0

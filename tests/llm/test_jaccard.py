"""Near duplicates (op 7) against brute force."""

from __future__ import annotations

import random
import re

import pytest

from wardlens.llm import jaccard_orders


def reference(rows):
    sets = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(200)]
    boiler = [rng.choice(vocabulary) for _ in range(60)]
    rows = []

    def add(words):
        rows.append((len(rows) * 7 - 50, rng.choice([" ", "\n", "  "]).join(words)))

    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 6, 12, 60, 150]))]
        if rng.random() < 0.4:
            base += boiler
        add(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            add([x.upper().replace("É", "é") for x in copy])
    group = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):
        copy = list(group)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        add(copy)
    rng.shuffle(rows)
    return [*rows, (9000, None), (9001, ""), (9002, " \n"), (9003, rows[0][1]), (9004, rows[0][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rows = corpus(seed)
    got = jaccard_orders.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == reference(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2), (8, "A b C d e f", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in jaccard_orders.near_duplicates(docs).collect())
    assert got == [(-1, 2, -1), (4, 2, 4), (8, 2, 4)]
    assert jaccard_orders.near_duplicates(docs.limit(0)).count() == 0
    kept = jaccard_orders.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 4, 4]

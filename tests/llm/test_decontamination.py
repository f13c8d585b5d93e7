"""Decontamination (op 3) against all windows of all documents."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from wardlens.llm import decontamination


def reference(docs, items, percent=80):
    out = set()
    for item_id, item in items:
        b = (item or "").lower().split()
        size = min(5, len(b))
        if not b:
            continue
        want = Counter(tuple(b[k : k + size]) for k in range(len(b) - size + 1))
        for doc_id, text in docs:
            w = (text or "").lower().split()
            for s in range(max(1, len(w) - len(b) + 1)):
                part = w[s : s + len(b)]
                have = Counter(tuple(part[k : k + size]) for k in range(len(part) - size + 1))
                common = sum((want & have).values())
                if have and 100 * common >= percent * (sum(want.values()) + sum(have.values()) - common):
                    out.add((doc_id, item_id))
    return out


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)] + ["Été", "ß"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([3, 6, 15, 30, 50])))) for k in range(30)] + [(90, None), (91, "")]
    items += [(92, items[3][1]), (93, " ".join(["same"] * 20))]
    docs = []
    for k in range(260):
        text = make(rng.choice([0, 2, 8, 40, 200]))
        if k % 2:
            passage = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if passage:
                    passage[rng.randrange(len(passage))] = rng.choice(words)
            if rng.random() < 0.3 and len(passage) > 20:
                passage = passage[1:] if rng.random() < 0.5 else passage[:10] + ["extra"] + passage[10:]
            at = rng.randint(0, len(text))
            text = text[:at] + passage + text[at:]
        docs.append((k, rng.choice([" ", "\n"]).join(text).upper() if k % 3 else " ".join(text)))
    docs += [(500, None), (501, ""), (502, " ".join(make(50_000)) + " " + items[5][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(table, benchmark).collect()
    want = reference(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 50
    assert all(r.hamming <= decontamination.RADIUS and r.similarity >= 0.8 for r in got)
    kept = decontamination.drop_leaks(table, benchmark)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontamination.leaks(table.limit(0), benchmark).count() == 0
    assert decontamination.drop_leaks(table, benchmark.limit(0)).count() == len(docs)


def test_moved_parts(spark):
    """Swapped halves, rotations, turned thirds and split passages: windows at every start count."""
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(4000)}"
    preface = [word() for _ in range(12)]  # shared by a third of the items, hence never rare
    items = []
    for k in range(36):
        body = [word() for _ in range(rng.choice([40, 41, 64, 90, 180]))]
        items.append((k, (preface + body if k % 3 == 0 else body)))
    docs = []
    for k in range(240):
        item = list(items[k % 36][1])
        n, cut = len(item), rng.randrange(1, len(item))
        way = k % 6
        if way == 0:
            item = item[n // 2 :] + item[: n // 2]
        elif way == 1:
            item = item[cut:] + item[:cut]
        elif way == 2:
            item = item[2 * n // 3 :] + item[n // 3 : 2 * n // 3] + item[: n // 3]
        elif way == 3:
            item = item[:cut] + [word() for _ in range(rng.randint(1, 8))] + item[cut:]
        elif way == 4:
            item = item[: n - rng.randint(0, n // 4)]
        around = [[word() for _ in range(rng.choice([0, 3, 150]))] for _ in range(2)]
        docs.append((k, " ".join(around[0] + item + around[1])))
    docs += [(900, " ".join(preface * 30)), (901, " ".join(w for _, i in items for w in i)), (902, " ".join(items[4][1] * 3))]
    items = [(k, " ".join(i)) for k, i in items] + [(99, " ".join(["same"] * 30))]
    docs += [(903, " ".join(["same"] * 3000)), (904, " ".join(["same"] * 24)), (905, " ".join(["same"] * 23))]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = decontamination.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = reference(docs, items)
    swapped = {k for k, _ in want if k < 240 and k % 6 in (0, 1, 2)}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(swapped) > 40


def test_rows_of_positions_are_narrow(spark):
    """Words meet the benchmark as rows without the shingles of their document, however large the benchmark is."""
    docs = decontamination._shingles(spark.createDataFrame([(1, 2, "a b c d e f")], "doc_id long, text_hash long, _text string"), 5)
    leads = spark.createDataFrame([(1, 2, 3)], "_shingle long, _item long, _wide int")
    node = decontamination._lead_hits(docs, leads, 5)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    sent = node.left().output().mkString(" ")
    while node.nodeName() != "Generate":
        node = node.children().head()
    assert "_shingles" not in sent and "_pos" in sent
    assert "_shingles" not in node.requiredChildOutput().mkString(" ")


def test_odd_rows(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(None, passage), (1, passage), (1, passage), (1, "clean text"), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, passage), (7, passage), (None, passage)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark).collect()}
    assert got == {(None, 7), (1, 7), (None, None), (1, None)}
    assert sorted((r.doc_id, r.text) for r in decontamination.drop_leaks(docs, benchmark).where("text IS NOT NULL").collect()) == [(1, "clean text")]

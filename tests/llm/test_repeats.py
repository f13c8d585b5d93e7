"""Repeated passages (op 4) and repeated byte strings (op 6) against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from wardlens.llm import phrase_automata, suffix_buckets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def phrase_reference(rows, window):
    texts = {i: WORD.findall((t or "").encode()) for i, t in rows}
    seen, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        w = texts[i]
        for s in range(len(w) - window + 1):
            if tuple(w[s : s + window]) in seen:
                gone[i].update(range(s, s + window))
            seen.setdefault(tuple(w[s : s + window]), (i, s))
    return {
        i: (len(w), len(gone[i]), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone[i])).hexdigest())
        for i, w in texts.items()
    }


def byte_reference(rows, window):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = defaultdict(list)
    for i, b in texts.items():
        for s in range(len(b) - window + 1):
            seen[b[s : s + window]].append((i, s))
    gone = {i: set() for i in texts}
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                gone[i].update(range(s, s + window))
    out = {}
    for i, b in texts.items():
        spans = sum(1 for k in gone[i] if k - 1 not in gone[i])
        kept = bytes(x for k, x in enumerate(b) if k not in gone[i])
        out[i] = (len(b), len(gone[i]), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, words=40, n=60):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["a", "be", "éa", "ñandu", "x" * 9]) + str(k) for k in range(words)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                text += rng.choice(passages)[rng.randint(0, 8) :]
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((k * 3 - 7, rng.choice([" ", "  ", "\n", "\t "]).join(text)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, ""), (1004, " \n "), (1005, "aaaa " * 150)]
    rows += [(1006, "z" * 700), (1007, "q" * 199), (1008, "q" * 200), (1009, "q" * 150)]
    return rows


@pytest.mark.parametrize("hot", [3, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_phrases(spark, seed, hot):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = phrase_automata.remove_repeats(docs, window=20, per_shard=200, hot=hot).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == phrase_reference(rows, 20)


@pytest.mark.parametrize("hot", [3, 20_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, hot):
    rows = corpus(seed, words=400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_buckets.remove_repeats(docs, window=200, per_shard=100, hot=hot).collect()
    want = byte_reference(rows, 200)
    assert {r.doc_id: tuple(r[1:]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize("hot", [3, 20_000])
def test_equal_hashes_of_different_text(spark, hot, monkeypatch):
    """With hashes of two bits everything collides; text decides what repeats, and two letters a word do as well."""
    import numpy as np
    import pyarrow as pa

    from wardlens.llm import anchors, arrays

    class Poor(arrays.Sums):
        def of(self, start, end):
            return super().of(start, end) % np.uint64(4)

    monkeypatch.setattr(arrays, "Sums", Poor)
    monkeypatch.setattr(phrase_automata, "ALPHABET", 40)
    rows = [(i, t or "") for i, t in corpus(3, words=300)]
    for words, locate, window, gram in ((True, phrase_automata.locate, 20, 6), (False, suffix_buckets.locate, 200, 32)):
        shape = anchors.Shape(words=words, window=window, gram=gram, hot=hot)
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        places = {}
        for r in anchors.recurring(docs, shape).collect():
            places.setdefault(r.doc_id, ([], []))[int(r.hot)].append(r.place)
        lists = [[places.get(i, ([], []))[k] for i, _ in rows] for k in (0, 1)]
        columns = [pa.array([i for i, _ in rows]), pa.array([t.encode() for _, t in rows]), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
        packed = [r for out in anchors._cut(shape, 1)([pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "cold", "hot"])]) for r in out.to_pylist()]
        shard, known = anchors._load(pa.Table.from_pylist(packed, anchors._schema()))
        segment, first, n = locate(shard, window)
        gone = {i: set() for i, _ in rows}
        for ids, starts, counts in [(shard.ids[segment], shard.starts[segment] + first, n), *known]:
            for i, start, count in zip(ids.tolist(), starts.tolist(), counts.tolist()):
                gone[i].update(range(start, start + count + window - 1))
        want = phrase_reference(rows, 20) if words else byte_reference(rows, 200)
        assert {i: len(g) for i, g in gone.items()} == {i: w[1] for i, w in want.items()}


def test_frequent_passages_of_rare_words(spark):
    texts = [" ".join(f"{c}{k}" for k in range(45)) for c in "abcdef"]
    rows = [(k, texts[k % 6]) for k in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = phrase_automata.remove_repeats(docs, hot=0).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == phrase_reference(rows, 20)


@pytest.mark.parametrize("operator", [phrase_automata, suffix_buckets])
def test_odd_rows(spark, operator):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, text, 1), (3, text, 2), (3, text, 2), (3, None, 2), (9, text, 5), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {(r.doc_id, r.n_removed > 0) for r in operator.remove_repeats(docs).collect()}
    assert (9, True) in got and (None, False) in got and (None, True) not in got
    assert ((3, True) in got) == (operator is suffix_buckets)
    assert operator.remove_repeats(docs.limit(0)).count() == 0


def test_refinement_in_one_piece():
    import numpy as np

    rng = random.Random(5)
    data = bytes(rng.choice(b"ab") for _ in range(400)) * 2
    flags = suffix_buckets.refine(np.frombuffer(data, np.uint8), np.full(len(data), len(data)), 50)
    want = [data.count(data[s : s + 50]) > 0 and len(re.findall(b"(?=" + data[s : s + 50] + b")", data)) > 1 if s + 50 <= len(data) else False for s in range(len(data))]
    assert flags.tolist() == want


@pytest.mark.parametrize("words", [True, False])
def test_frequent_anchors_are_counted_by_occurrence(spark, words):
    import numpy as np
    import pyarrow as pa

    from wardlens.llm import anchors

    text = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string").coalesce(1)
    shape = anchors.Shape(words=words, window=20 if words else 200, gram=6 if words else 32, hot=50)
    found = anchors.recurring(docs, shape).collect()
    assert found and all(r.hot for r in found)
    places = sorted({r.place for r in found})
    kept = {}
    for hot in (False, True):
        lists = [[] if hot else places] * 60, [places if hot else []] * 60
        columns = [pa.array(range(60)), pa.array([text.encode()] * 60), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
        batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "cold", "hot"])
        rows = [r for out in anchors._cut(shape, 3)([batch]) for r in out.to_pylist()]
        kept[hot] = sum(r["n"] for r in rows if r["kind"] != 1)
        known = [(r["n"], np.frombuffer(r["counts"], np.int32).sum()) for r in rows if r["kind"] == 1]
        windows = len(text.split()) - 19 if words else len(text) - 199
        assert sum(n for _, n in known) == 59 * windows
        assert not hot or sum(n for n, _ in known) == 59  # neighbouring windows as one run
    assert kept[True] == windows and kept[False] < windows

"""Fill-in-middle (op 13) against a plain version on whole texts."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wardlens.llm import fill_middle


def reference(doc_id, text, seed="1"):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_digests(spark, size):
    rng = random.Random(13)
    bits = ["word", "Ab", " ", "\n", "é", "漢字", "😀", "<", ">", "<P", "M>", "0", "\u0000", "x" * 40]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(400)]
    rows += [(k, "text with <S> inside") for k in range(400, 410)]
    rows += [(None, "no id at all"), (None, None), (500, None), (501, ""), (502, "one"), (503, "a" * 300_000), (504, "é b " * 60_000)]
    rows += [(600, "twice the same"), (600, "twice the same"), (600, "but another text")] + [(601, "often " * 30)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("place", "piece", "sign", "times", "n", "form"):
        docs = docs.withColumn(name, F.lit("x"))
    pieces = fill_middle.pieces(docs.repartition(7), size=size)
    got = fill_middle.digests(pieces).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted((reference(*r) for r in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    longest = pieces.agg(F.max(F.length("piece"))).first()[0]
    assert longest <= size + 3


def test_pieces_make_the_output(spark):
    docs = spark.createDataFrame([(k, f"alpha beta, gamma {k}! delta") for k in range(60)], "doc_id long, text string")
    texts = {}
    for r in fill_middle.pieces(docs, size=8).collect():
        texts[r.doc_id] = texts.get(r.doc_id, b"") + r.piece
    for k, text in docs.collect():
        assert hashlib.sha256(texts[k]).hexdigest() == reference(k, text)[5]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = fill_middle.digests(fill_middle.pieces(docs))
    assert got.count() == 0 and got.columns[-2:] == ["output_sha256", "restored_sha256"]

"""The pipeline's rows against brute force, stage by stage, on a planted corpus."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm import test_decontamination, test_jaccard, test_mixing, test_quality, test_secrets
from wardlens.llm import queries


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, t, lang or "en", source or "src1") for i, t, lang, source in test_quality.corpus(seed=4, n=300)]
    items = [(k, " ".join(rng.choice(rows[5 * k][1].split()) for _ in range(30))) for k in range(5)]
    extra = []
    for k, (_, text, lang, source) in enumerate(rows[:60]):
        words = (text or "").split()
        if k % 3 == 0:
            words[k % len(words)] = "changed"
        elif k % 3 == 1:
            words[10:10] = items[k % 5][1].split()
        else:
            words.insert(5, "password=b7db7aa4a5fcc78305")
        extra.append((1000 + k, " ".join(words), lang, source))
    rows = [(i, t, lang, "src" + str(len(s) + i % 3)) for i, t, lang, s in rows + extra]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    quality = test_quality.reference(rows, 60)
    left = [r for r in rows if quality[r[0]][2]]
    groups = test_jaccard.reference([r[:2] for r in left])
    left = [r for r in left if groups[r[0]][1] == r[0]]
    leaks = {i for i, _ in test_decontamination.reference([r[:2] for r in left], items)}
    left = [r for r in left if r[0] not in leaks]
    left = [r for r in left if not test_secrets.base_reference(r[1] or "")]
    assert 0 < len(left) < len(rows) - 60
    trees = [(i, t, f"d{int(s[3:]) % 4}", lang, s) for i, t, lang, s in left]
    want = test_mixing.reference(trees, queries.MIX_WEIGHTS, queries.MIX_SHARE, 4, 0)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.copies) for r in got) == want
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_clashing_names_and_odd_rows(spark, tmp_path):
    """Names that operators use inside, null ids and texts, repeated rows: no stage fails or changes what it keeps."""
    passage = " ".join(f"item{k}" for k in range(30))
    prose = "every stage keeps this plain document as it is because nothing in it is wrong or said twice"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [
        (1, prose), (2, None), (3, ""), (None, prose), (None, None), (4, prose), (5, prose + " " + passage),
        (6, prose + " password=b7db7aa4a5fcc78305"), (7, "x" * 200_000), (8, "other words " + prose), (8, "other words " + prose),
    ]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("_bad_id", "_bad_text", "_copy_id", "_GONE_0", "_gone_1", "__gone_0", "text_hash", "kept", "component_id", "item_id", "spans", "n", "k", "hash", "tree"):
        docs = docs.withColumn(name, F.lit(7))
    gone = {"quality_rules": set(), "near_duplicates": {4, 6, 8}, "benchmark_decontamination": {5}, "secret_scans": {6}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        kept = [r.doc_id for r in got.collect()]
        if name == "quality_rules":
            assert {1, 4, 5, None} <= set(kept)
        else:
            assert sorted(kept, key=str) == sorted((i for i, _ in rows if i not in gone[name]), key=str), name

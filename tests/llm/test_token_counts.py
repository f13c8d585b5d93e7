"""Token counts (op 2) against whole-text encoding."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wardlens.llm import token_counts

TEXTS = [
    "a  b", "a ", " a", "  ", "a   b  c ", "▁ x", "x▁ y", "a▁ ▁b", "\n a \n", " \n", "<s> a </s>", "ﬁn élan  naïve\tß", "",
    None, "word " * 30_000, "x" * 20_000, "é́ ́a 漢字 漢字", "<|endoftext|> a",
]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts(spark, name):
    path = public_tokenizers.path(name)
    rows = [(None if k == 3 else k, t, k) for k, t in enumerate(TEXTS + TEXTS[:4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(map(tuple, token_counts.count_tokens(docs, path).collect()), key=str)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_cache_bound():
    counter = token_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), cache_bytes=2000)
    texts = [" ".join(f"w{k * j}" for j in range(50)) for k in range(40)]
    assert [counter.count([t])[0] for t in texts] == [len(counter.model.encode(t)) for t in texts]
    assert counter.held < 20_000

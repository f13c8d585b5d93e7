"""Token counts of whole texts by a public tokenizer (operator 2).

Texts are encoded in Arrow batches; only lengths leave the workers. Batches handed to the
tokenizer are balanced by bytes, and long texts are cut where no token can cross the cut,
so memory does not grow with a text and equal pieces need encoding once.

Safe cuts for a sentencepiece model: every space becomes the mark U+2581 and the model puts
one mark in front of a text. If no vocabulary piece holds a mark after another character,
no token crosses from a non-mark to a mark. A text can then be cut at a space that follows
another character and has something behind it: the space is dropped and the mark in front
of the next piece takes its place. Models without this property get whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
CACHE_BYTES = 32 << 20
MARK = "▁"
_PROBE = "Aa  zé ﬁ Ω　x\tb\n c"
_CUT = re.compile(f"(?<=[^ {MARK}]) (?=.)", re.S)


class PieceCounter:
    """Counts tokens of texts with a sentencepiece model; pieces are cached within a byte bound."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        self.splits = not crossing and self.model.normalize(_PROBE) == MARK + _PROBE.replace(" ", MARK)
        self.cache: dict[str, int] = {}
        self.bound, self.held = cache_bytes, 0

    def lengths(self, texts: list[str]) -> list[int]:
        """Token count of every text, encoded in batches of bounded bytes."""
        return [len(ids) for part in by_bytes(texts) for ids in self.model.encode(part, num_threads=1)]

    def pieces(self, text: str) -> list[str]:
        """Independent parts of a text; their token counts add up to that of the text."""
        if not self.splits:
            return [text]
        if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            return _CUT.split(text)
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        """Token count of every text."""
        if not self.splits:
            return self.lengths(texts)
        parts = [self.pieces(text) for text in texts]
        new = list(set().union(*parts) - self.cache.keys())
        if self.held > self.bound:
            self.cache, self.held = {}, 0
            new = list(set().union(*parts))
        self.cache.update(zip(new, self.lengths(new), strict=True))
        self.held += sum(map(len, new)) + 100 * len(new)
        return [sum(map(self.cache.__getitem__, part)) for part in parts]


class FileCounter:
    """Counts tokens with a tokenizers file; special strings in texts are kept as the library's default has it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        """Token count of every text."""
        return [
            len(e.ids) for part in by_bytes(texts) for e in self.model.encode_batch(part, add_special_tokens=False)
        ]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter | FileCounter:
    """The counter for a vocabulary file, once per worker."""
    return FileCounter(path) if path.endswith(".json") else PieceCounter(path)


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive lists of at most ``limit`` characters each; a longer text stands alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null; repeated rows give
    repeated results; other columns, whatever their names, are not read. An empty table gives
    an empty one. ``model_path`` must be readable on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            texts, sizes, counts = batch.column(2), batch.column(1).to_pylist(), []
            first = 0
            while first < len(sizes):
                last, held = first, 0
                while last < len(sizes) and (last == first or held + sizes[last] <= 4 * BATCH_BYTES):
                    held += sizes[last]
                    last += 1
                counts += model.count(texts.slice(first, last - first).to_pylist())
                first = last
            n = pa.array(counts, pa.int64())
            over = pa.array([c > limit for c in counts], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = dict(docs.select(id_col).dtypes)[id_col]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Removal of repeated passages by sharded Aho-Corasick automata (operator 4).

A window is 20 consecutive words of one document. Candidate regions come from content-chosen
anchors (``anchors``), so all occurrences of a recurring window meet in one shard. In a
shard, windows that occur twice are confirmed as recurring passages; each becomes a pattern
of one letter per word, the patterns are compiled into one pyahocorasick automaton, and
every segment of every document is streamed through it. The automaton locates the
occurrences word by word, so equal hashes of different passages remove nothing. All
occurrences but the first (smallest doc_id, then start) are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm import anchors, arrays
from wardlens.llm.tables import unique_documents

PER_SHARD = 8_000
_BREAK, _OTHER, _SURROGATES = 0, 1, 0xD800
ALPHABET = 1_100_000  # code points to tell words apart


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One or two code points per word, as columns, equal for equal words. Words that occur once in the shard share
    one; no pattern holds them, but for segments that stand for several (``own``), whose words all have their own.

    Beyond ALPHABET words a word has a high and a low letter from two alphabets, so no match can start between them.
    """
    _, first, back, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    codes: dict[bytes, int] = {}
    word = np.full(len(first), -1)
    for k in np.flatnonzero((times > 1) | own[first]).tolist():
        word[k] = codes.setdefault(data[starts[first[k]] : ends[first[k]]].tobytes(), len(codes))
    if len(codes) <= ALPHABET:
        letter = (word + _OTHER + 1)[:, None]
    else:
        half = ALPHABET // 2
        letter = np.stack([word // half, half + word % half], axis=1) + _OTHER + 1
        letter[word < 0] = (_OTHER, half + _OTHER)
    letter = np.where(letter < _SURROGATES, letter, letter + 0x800).astype(np.uint32)
    return letter[back]


def locate(shard: anchors.Shard, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the shard that occur earlier: (segment, first window inside it, number)."""
    none = np.zeros(0, np.int64)
    starts, ends, rows = arrays.words(shard.data, shard.offsets)
    if len(starts) < window:
        return none, none, none
    hashes = arrays.span_hashes(shard.data, starts, ends)
    first_word = np.searchsorted(rows, np.arange(len(shard.ids) + 1))
    n_windows = np.asarray(shard.counts, np.int64)
    segment = np.repeat(np.arange(len(shard.ids)), n_windows)
    inside = np.arange(len(segment)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = first_word[segment] + inside
    runs = arrays.grams(hashes, window)[at]
    # recurring windows, and the first of each: segments and windows lie in (doc_id, start) order
    order = np.argsort(runs, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(runs[order])) + 1, [len(order)]])
    times = np.diff(cut)
    earliest = _earliest(shard, segment, inside, order, cut)
    patterns = earliest[(times > 1) | shard.repeated[segment[earliest]]]
    if not len(patterns):
        return none, none, none
    letters = _letters(shard.data, starts, ends, hashes, shard.repeated[rows])
    # one text for the shard, with a break between segments; the iterator copies its text per call
    wide = letters.shape[1]
    spread = np.full((len(letters) + len(shard.ids), wide), _BREAK, np.uint32)
    spread[np.arange(len(letters)) + rows] = letters
    text = spread.tobytes().decode("utf-32-le", "surrogatepass")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, word in enumerate((at + segment)[patterns].tolist()):
        automaton.add_word(text[word * wide : (word + window) * wide], number)
    automaton.make_automaton()
    later = np.zeros(len(segment), bool)
    first_window = np.cumsum(n_windows) - n_windows
    found_at = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
    back = np.cumsum(spread[:, 0] != _BREAK) - 1
    word_of, pattern_of = back[(found_at[:, 0] + 1) // wide - window], found_at[:, 1]
    in_segment = rows[word_of]
    place = word_of - first_word[in_segment]
    found = first_window[in_segment] + place
    ok = place < n_windows[in_segment]
    ok[ok] &= found[ok] != patterns[pattern_of[ok]]
    later[found[ok]] = True
    first, n = anchors.consecutive(later, segment)
    return segment[first], inside[first], n


def _earliest(shard, segment, inside, order, cut) -> np.ndarray:
    """The window with the smallest (doc_id, start) of each run of equal windows."""
    ids, starts = shard.ids[segment[order]], shard.starts[segment[order]] + inside[order]
    run = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    by = np.lexsort((starts, ids, run))
    return order[by][cut[:-1]]


def _apply(window: int):
    """Kept words of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().split()
                gone = anchors.covered(runs, window, len(words)) if runs else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    gram: int = 6,
    per_shard: int = PER_SHARD,
    hot: int = 20_000,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per document, and ``runs``: removed windows as (start, n).

    A null or empty text has no words. Rows with equal ids count as one document with the
    greatest of their texts; rows without an id are returned as they are, with nothing removed
    and no part in the comparison. Other columns are not read; an empty table gives an empty one.
    """
    known, nameless = unique_documents(docs, id_col, text_col)
    shape = anchors.Shape(words=True, window=window, gram=gram, hot=hot)
    found = anchors.recurring(known, shape)
    runs = anchors.repeated_windows(known, found, shape, lambda shard: locate(shard, window), per_shard)
    rows = known.join(runs, "doc_id", "left").unionByName(nameless, allowMissingColumns=True)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "runs")
    return rows.mapInArrow(_apply(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")

"""Secret scans by fixed patterns and a battery of randomness tests (operator 9).

The patterns give the base spans. Other long tokens are tested, cut at inner equals signs (name=value)
and, besides as a whole, in the parts between '-' and '_', between '/' and '+', and between all four: of
overlapping parts the least text-like counts, at a level lowered for the choice. An encoding is inferred (the
smallest alphabet that holds all characters), and chi-squared uniformity over that alphabet, a
runs test about its middle and the serial correlation of neighbours are combined after Fisher.
A token that looks random is a secret only if ordinary text does not explain it: with the
letter frequencies of the whole corpus as null model, the likelihood ratio against the uniform
alphabet bounds the p-value (Markov's inequality), so long tokens can reach small values and
short ones cannot. False discoveries are controlled over all tokens of the corpus after
Benjamini and Hochberg, with weights that grow with the token's length. The step uses counts
of p-values in fine bins, so no list of tokens is ever sorted in one place.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm import arrays
from wardlens.llm.tables import materialize, without

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_PIECE = re.compile("[^=]+")
_SPLITS = (re.compile("[^_-]+"), re.compile("[^/+]+"), re.compile("[^/+_-]+"))
MIN_TOKEN = 20
_DIGITS, _LOW, _HIGH = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _HIGH + "234567",
    "base36": _DIGITS + _LOW, "BASE36": _DIGITS + _HIGH, "base62": _HIGH + _LOW + _DIGITS,
    "base64": _HIGH + _LOW + _DIGITS + "+/", "base64url": _HIGH + _LOW + _DIGITS + "-_",
}
_SETS = {name: (frozenset(a), {c: k for k, c in enumerate(a)}) for name, a in ALPHABETS.items()}
ALL = "".join(sorted(set("".join(ALPHABETS.values()))))
BINS = 8
_NORMAL = NormalDist()
_ROW = "doc_id {id}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,stop:int>>, tested array<struct<start:int,kind:int,stop:int,level:double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds all characters of a token."""
    have = set(token)
    fits = [(len(s), name) for name, (s, _) in _SETS.items() if have <= s]
    return min(fits)[1] if fits else None


def battery(token: str, name: str) -> float:
    """Combined p-value of the three tests under a uniform choice of characters."""
    index, size, n = _SETS[name][1], len(ALPHABETS[name]), len(token)
    x = [index[c] for c in token]
    chi = sum(k * k for k in Counter(x).values()) * size / n - n
    dof = size - 1
    z = ((max(chi, 1e-9) / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    uniform = 1 - _NORMAL.cdf(z)
    high = [2 * v >= size for v in x]
    n_high = sum(high)
    n_low = n - n_high
    if n_high and n_low:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        mean = 2 * n_high * n_low / n + 1
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        order = 2 * (1 - _NORMAL.cdf(abs(runs - mean) / spread))
    else:
        order = 2.0 ** (1 - n)
    middle = sum(x) / n
    square = sum((v - middle) ** 2 for v in x)
    if square:
        serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:], strict=False)) / square
        related = 2 * (1 - _NORMAL.cdf(abs(serial + 1 / n) * math.sqrt(n)))
    else:
        related = 2.0 ** (1 - n)
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, order, related))
    return math.exp(-half) * (1 + half + half * half / 2)  # chi-squared with 6 degrees of freedom


def text_level(token: str, name: str, logs: dict[str, float]) -> float:
    """-log10 of a bound on the p-value of a token under the corpus's letter frequencies."""
    ratio = sum(-math.log(len(ALPHABETS[name])) - logs[c] for c in token)
    return max(0.0, (ratio - math.log(len(ALPHABETS))) / math.log(10))


def parts(token: str) -> list[tuple[list[tuple[int, int]], int]]:
    """Per piece of a token between equals signs: bounds of the parts to test, and in how many ways it was cut."""
    out = []
    for m in _PIECE.finditer(token):
        cuts = {((m.start(), m.end()),)}
        cuts |= {tuple(x.span() for x in split.finditer(token, m.start(), m.end())) for split in _SPLITS}
        spans = sorted({(a, b) for cut in cuts for a, b in cut if b - a >= MIN_TOKEN and encoding(token[a:b])})
        if spans:
            out.append((spans, len(cuts)))
    return out


def token_levels(token: str, blocked: list[tuple[int, int]], logs: dict[str, float], p_random: float) -> list[tuple[int, int, float]]:
    """(start, end, level) of the tested parts of a token, none over another or over ``blocked``, in order."""
    out = []
    for spans, ways in parts(token):
        tried = []
        for a, b in spans:
            if any(x < b and a < y for x, y in blocked):
                continue
            name = encoding(token[a:b])
            random = battery(token[a:b], name) >= p_random
            tried.append((max(0.0, text_level(token[a:b], name, logs) - math.log10(ways)) if random else 0.0, a, b))
        end_of: dict[int, int] = {}
        starts: list[int] = []
        for level, a, b in sorted(tried, key=lambda t: (-t[0], t[1] - t[2], t[1])):
            k = bisect.bisect_left(starts, a)
            if (k == 0 or end_of[starts[k - 1]] <= a) and (k == len(starts) or b <= starts[k]):
                starts.insert(k, a)
                end_of[a] = b
                out.append((a, b, level))
    return sorted(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(256, np.int64)
    for batch in batches:
        data, _ = arrays.buffers(batch.column(0))
        for at in range(0, len(data), arrays.CHUNK):
            counts += np.bincount(data[at : at + arrays.CHUNK], minlength=256)
    letters = np.frombuffer(ALL.encode(), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(ALL)), pa.array(counts[letters])], ["letter", "n"])


def _scan(logs: dict[str, float], p_random: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, digests, bases, tests = ([], [], []), [], [], []
            for text in batch.column(1):
                text = text.as_py()
                base = base_spans(text)
                for kind in range(3):
                    numbers[kind].append(sum(k == kind for _, k, _ in base))
                joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                bases.append([{"start": a, "kind": k, "stop": b} for a, k, b in base])
                tested = []
                for m in _TOKEN.finditer(text):
                    token, at = m[0].rstrip("="), m.start()
                    blocked = [(a - at, b - at) for a, _, b in base if a < m.end() and at < b]
                    for a, b, level in token_levels(token, blocked, logs, p_random):
                        stop = m.end() if b == len(token) else at + b  # padding belongs to the last part
                        tested.append({"start": at + a, "kind": 3, "stop": stop, "level": level})
                tests.append(tested)
            span = [("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string())]
            columns.append(pa.array(bases, pa.list_(pa.struct(span))))
            columns.append(pa.array(tests, pa.list_(pa.struct([*span, ("level", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tested"]
            )

    return run


def _threshold(tested: DataFrame, rate: float) -> float:
    """Smallest level (-log10 p, weighted by length) at which the false discovery rate stays below ``rate``."""
    size = F.least(F.col("stop") - F.col("start"), F.lit(64)).cast("double")
    total = tested.agg(F.count("*").alias("m"), F.avg(size).alias("mean")).first()
    if not total["m"]:
        return math.inf
    level = F.col("level") + F.log10(size / total["mean"])
    bins = tested.groupBy(F.greatest(F.lit(0), F.least(F.floor(level * BINS), F.lit(200 * BINS))).alias("bin")).count()
    found, best = 0, math.inf
    for row in bins.orderBy(F.desc("bin")).collect():  # at most 200 * BINS + 1 rows
        found += row["count"]
        if 10 ** (-row["bin"] / BINS) <= rate * found / total["m"]:
            best = row["bin"] / BINS
    return best + math.log10(total["mean"])


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, p_random: float = 1e-3
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``.

    Spans are kind:start:end in code points, by start, then kind. A null text counts as empty
    and has none; null ids stay null; repeated rows give repeated results (and count as
    repeated tokens). Other columns are not read; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    counts = docs.select(text.cast("binary").alias("text")).mapInArrow(_count, "letter string, n long")
    counts = {r["letter"]: r["n"] for r in counts.groupBy("letter").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values()) + len(ALL)
    logs = {c: math.log((counts.get(c, 0) + 1) / total) for c in ALL}
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(
        _scan(logs, p_random), _ROW.format(id=kind)
    )
    rows = materialize(rows, "secret-tokens")
    tested = rows.select(F.explode("tested").alias("t")).select("t.*")
    best = _threshold(tested, rate)
    long_enough = lambda t: t["level"] + F.log10(F.least(t["stop"] - t["start"], F.lit(64))) >= best
    plain = lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["stop"].alias("stop"))
    added = F.transform(F.filter("tested", long_enough), plain) if best < math.inf else F.lit(None)
    spans = F.array_sort(F.concat("base", added) if best < math.inf else F.col("base"))
    names = F.array(*map(F.lit, KINDS))
    written = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"]))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(written, ",").alias("spans"))


def drop_leaky(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without secrets, columns as they are; rows without id are judged by their text too."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    text_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), text_hash.alias("hash")).alias("doc_id"), F.col(text_col).alias("text"))
    found = scan(keyed, "doc_id", "text", **{k: v for k, v in options.items() if k not in ("id_col", "text_col")})
    bad = found.where("spans <> ''").select("doc_id.id", "doc_id.hash")
    return without(docs, bad, docs[id_col], text_hash)

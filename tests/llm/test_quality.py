"""Quality rules (op 10): base statistics and robust outliers against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from wardlens.llm import outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)),
    }


def vector(s):
    words, chars = max(s["n_words"], 1), max(s["word_chars"], 1)
    values = [
        math.log(words), math.log(chars / words), math.sqrt(s["n_symbols"] / chars),
        math.sqrt(s["n_dup_lines"] / max(s["n_lines"], 1)), math.sqrt(s["n_repeat_words"] / words), math.sqrt(s["n_upper"] / chars),
    ]
    return [int(math.floor(v * 4096 + 0.5)) for v in values]


def distances(x):
    """Squared distances by the stated steps, with numpy's own linear algebra."""
    floors = np.array(list(outliers.FLOORS.values()))
    n, dims = x.shape
    grid = np.sort(np.floor(x / 16), axis=0) * 16 + 8
    at = lambda q: grid[math.ceil(q * n) - 1] / 4096
    mean, spread = at(0.5), at(0.75) - at(0.25)
    cov = np.diag((spread / 1.349) ** 2 + floors**2)
    factor = 0.75 / outliers.chi2_cdf(outliers.chi2_quantile(0.25, dims), dims + 2)
    d2 = lambda: np.einsum("ij,jk,ik->i", x / 4096 - mean, np.linalg.inv(cov), x / 4096 - mean)
    for _ in range(6):
        bins = np.floor(np.log2(d2() + 1e-6) * 16)
        cut = np.sort(bins)[math.ceil(0.75 * n) - 1]
        near = x[bins <= cut] / 4096
        mean = near.mean(axis=0)
        cov = np.cov(near.T, bias=True) * factor + np.diag(floors**2)
    return d2()


def reference(rows, min_group):
    """(statistics, base_failed, kept, distance) per row."""
    out, groups = {}, defaultdict(list)
    for i, text, lang, source in rows:
        s = statistics(text)
        failed = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        out[i] = [s, failed, not failed, None]
        if not failed:
            groups[lang, source].append(i)
    for size_of in ("lang", "all"):
        small = [k for k, v in groups.items() if len(v) < min_group]
        for k in small:
            groups[(k[0],) if size_of == "lang" else ()] += groups.pop(k)
    for members in groups.values():
        d2 = distances(np.array([vector(out[i][0]) for i in members]))
        for i, d in zip(members, d2, strict=True):
            out[i][3] = d
            out[i][2] = not (d > outliers.chi2_quantile(1e-9, 6) and len(members) >= min_group)
    return out


def corpus(seed=1, n=500):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(int(rng.lognormvariate(5, 0.6)))]
        text = ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9)).replace(". ", rng.choice([". ", ".\n"]))
        kind = rng.random()
        if kind < 0.04:
            text = " ".join(w + "***###" for w in words)
        elif kind < 0.07:
            text = text.upper()
        elif kind < 0.10:
            text = "same line again and again\n" * 30 + text
        rows.append((k, text, rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", None])))
    return rows + [(9000, None, "en", "s0"), (9001, "", None, None), (9002, "a b c d e f g h i j", "en", "s0"), (9003, "x y " * 4000, "en", "s0")]


def test_judge(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = reference(rows, 40)
    for parts in (1, 7):
        got = outliers.judge(docs.repartition(parts), min_group=40).collect()
        assert len(got) == len(rows)
        for r in got:
            s, failed, kept, distance = want[r.doc_id]
            assert [r[c] for c in outliers.COUNTS] == [s[c] for c in outliers.COUNTS]
            assert (r.base_failed, r.kept) == (failed, kept), (r, distance)
            assert (r.distance is None) == (distance is None)
            assert distance is None or abs(r.distance - distance) < 1e-6 * (1 + distance)
    assert sum(not w[1] and not w[2] for w in want.values()) > 10


def test_odd_rows(spark):
    rows = [(None, "word " * 3, None, None, 1), (1, "a b c d e f g h i j k", "en", "s", 2), (1, "a b c d e f g h i j k", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    got = sorted((r.doc_id or 0, r.kept) for r in outliers.judge(docs).collect())
    assert got == [(0, False), (1, True), (1, True)]
    kept = outliers.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    assert outliers.judge(docs.limit(0)).count() == 0 and outliers.keep_good(docs.limit(0)).count() == 0


def test_each_statistic_alone_can_reject(spark):
    rng = random.Random(12)
    word = lambda low=3, high=9: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(low, high)))
    lines = lambda n, *sizes: [" ".join(word(*sizes) for _ in range(9)) for _ in range(n)]
    rows = [(k, "\n".join(lines(rng.randint(18, 26)))) for k in range(300)]
    body = lines(20)
    boiler = [x for line in body for x in (line, "menu")]
    repeated = " ".join(body).split()
    repeated[100:115] = repeated[20:35]  # 30 of 180 words
    planted = {
        "dup_lines": "\n".join(boiler), "repeats": "\n".join(" ".join(repeated[k : k + 9]) for k in range(0, 180, 9)),
        "symbols": "\n".join(x[:-6] + "#*$%#*" for x in body), "log_length": "\n".join(lines(20, 11, 15)),
        "upper": "\n".join(lines(20)).upper(), "log_words": "\n".join(lines(1500)),
    }
    rows += [(1000 + k, text) for k, text in enumerate(planted.values())]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge(docs).collect()}
    assert all(got[k].kept for k in range(300))
    for k, name in enumerate(planted):
        assert not got[1000 + k].base_failed and not got[1000 + k].kept, (name, got[1000 + k])

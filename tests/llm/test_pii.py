"""Pseudonyms (op 8): formats, linkage, exact inversion, and texts left alone."""

from __future__ import annotations

import random
import re

from wardlens.llm import pii_feistel as pii

KEY = b"test key"


def test_permutation():
    f = pii.Feistel(KEY)
    for bound in (1, 2, 3, 10, 97, 1000):
        images = [f.permute("x", v, bound) for v in range(bound)]
        assert sorted(images) == list(range(bound))
        assert [f.permute("x", v, bound, True) for v in images] == list(range(bound))
    assert [f.permute("x", v, 1000) for v in range(50)] != [f.permute("y", v, 1000) for v in range(50)]


def card(rng, gap=""):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    number = body + pii.luhn_digit(body)
    return gap.join(number[k : k + 4] for k in range(0, 16, 4))


def test_documents(spark):
    rng = random.Random(4)
    makers = [
        lambda: card(rng), lambda: card(rng, "-"), lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
        lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"{rng.randint(1950, 2020)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}",
        lambda: f"1{rng.randint(0, 9)}.0{rng.randint(1, 9)}.19{rng.randint(10, 99)}", lambda: f"Ab{rng.randint(1, 99)}.c-d@mail{rng.randint(1, 9)}.example.com",
    ]
    values = [m() for m in makers for _ in range(6)]
    clean = "déjà 4111111111111112 1.2.3 2021-13-01 30.02.1999 999.1.1.1 12345678901234567 v1.2.3.4.5 a@b x@y.z"
    rows = []
    for k in range(60):
        some = [rng.choice(values) for _ in range(k % 4)]
        rows.append((k, clean + " " + " and ".join(some) + ("." if k % 2 else " end")))
    rows += [(90, None), (91, ""), (None, values[0]), (92, "y " * 300_000 + values[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = pii.replace_personal_data(docs, KEY)
    got = {r.doc_id: r for r in out.collect()}
    links: dict[str, set] = {}
    for i, text in rows:
        r = got[i]
        if text is None:
            assert r.text is None and r.spans == ""
            continue
        assert len(r.text) == len(text)
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert [text[a:b] for a, b in spans] == [m for m in re.findall("|".join(map(re.escape, sorted(values, key=len, reverse=True))), text)]
        at = 0
        for a, b in spans:
            assert r.text[at:a] == text[at:a]
            links.setdefault(text[a:b], set()).add(r.text[a:b])
            at = b
    assert all(len(v) == 1 for v in links.values())
    assert len({next(iter(v)) for v in links.values()}) == len(links)
    for value, (new,) in ((k, tuple(v)) for k, v in links.items()):
        assert re.sub("[0-9]", "0", value) == re.sub("[0-9]", "0", new) or "@" in value
    back = pii.replace_personal_data(out.select("doc_id", "text"), KEY, inverse=True)
    assert {r.doc_id: r.text for r in back.collect()} == dict(rows)
    assert pii.replace_personal_data(docs.limit(0), KEY).count() == 0


def test_all_area_codes_and_card_lengths():
    f = pii.Feistel(KEY)
    rng = random.Random(6)
    values = [("phone", form.format(code)) for code in range(1000) for form in ("+1 ({:03d}) 555-7713", "{:03d}-555-0199")]
    layouts = [[n] for n in range(13, 20)] + [[4, 6, 5], [4, 6, 4], [4, 4, 5], [4, 4, 4, 1], [4, 4, 4, 4], [4, 4, 4, 4, 2], [4, 4, 4, 4, 3], [6, 13]]
    for groups in layouts:
        for first in ("2221", "2720", "34", "37", "4", "6"):
            for gap in " -":
                body = first + "".join(rng.choice("0123456789") for _ in range(sum(groups) - 1 - len(first)))
                digits, cuts = body + pii.luhn_digit(body), [sum(groups[:k]) for k in range(len(groups) + 1)]
                value = gap.join(digits[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
                values.append(("card", value))
    images = {}
    for kind, value in values:
        text = f"is {value}, and"
        new, spans = pii.pseudonymize(f, text)
        digits = re.sub("[^0-9]", "", value)
        if value.count(" ") == 4 and pii.luhn_digit(digits[:15]) == digits[15]:
            value = value[:19]  # the first 16 digits are a card by themselves
        assert spans == [(kind, 3, 3 + len(value))], value
        assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", text)
        assert pii.pseudonymize(f, new, inverse=True)[0] == text
        assert images.setdefault(new, text) == text
    some = [v for _, v in values] + ["4111 1111 1111 1112", "10.0.0.1", "2020-01-02", "12", "a.b@c.de", "5555 5555 5555"]
    for _ in range(3000):
        text = " ".join(rng.choice(some) for _ in range(6))
        assert pii.pseudonymize(f, pii.pseudonymize(f, text)[0], inverse=True)[0] == text

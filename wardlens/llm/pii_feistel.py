"""Personal data replaced by format-preserving pseudonyms (operator 8).

Validated numbers (payment cards of 13 to 19 digits by leading digit 2 to 6 and Luhn check, phone
numbers with any area code, IPv4 addresses), dates and e-mail addresses are permuted within their own format by a keyed
Feistel network: a card becomes a card with a valid check digit, a date a date of the
same layout, an address an address in the same domain. A permutation has no collisions, so
equal values stay linked across documents and different values stay apart.

The network works on whole numbers below a bound: the number is split into two halves of
digits, each of ten rounds adds a keyed hash of one half to the other, and results at or above
the bound are permuted again until they fall below (cycle walking).
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "card", "phone", "ipv4", "date")
ROUNDS = 10
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_EMAIL = r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-]))"
# Cards of 13 to 19 digits in one piece or in the usual groups. A short last group may be the start of another
# value (a phone number, an address), so what follows it decides.
_TAIL = r"(?![\w@%+-]|[./]\w|[ .-][0-9]{3}[ .-][0-9]{4})"
_CARD = (
    r"(?P<card>(?<![\w.-])(?:[2-6][0-9]{12,18}(?![\w-])|[2-6][0-9]{3}(?P<gap>[ -])(?:"
    r"[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}(?![\w-])"
    r"|[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)(?:[0-9]{4}(?P=gap))?[0-9]{1,3}" + _TAIL + r"|[0-9]{4}(?P=gap)[0-9]{5}" + _TAIL
    + r"|[0-9]{6}(?P=gap)[0-9]{4,5}" + _TAIL + r")|[2-6][0-9]{5}[ -][0-9]{7,13}" + _TAIL + "))"
)
_LONG = re.compile(r"[2-6][0-9]{3}(?: [0-9]{4}){3} [0-9]{1,3}" + _TAIL, re.ASCII)
_PHONE = r"(?P<phone>(?<![\w+.-])(?:\+1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+.-])(?:\+1[ .-]?)?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-]))"
_IPV4 = r"(?P<ipv4>(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9]))"
_DATE = r"(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-]|\.[0-9]))"
_ANY = re.compile("|".join((_EMAIL, _CARD, _PHONE, _IPV4, _DATE)), re.ASCII)
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # 1900-01-01 to 2099-12-31


class Feistel:
    """Keyed permutations of the whole numbers below a bound."""

    def __init__(self, key: bytes) -> None:
        self.key = key
        self.permute = lru_cache(maxsize=100_000)(self._permute)

    def _round(self, label: str, number: int, half: int, bound: int) -> int:
        text = f"{label}|{bound}|{number}|{half}".encode()
        return int.from_bytes(hmac.digest(self.key, text, hashlib.sha256)[:16], "big")

    def _once(self, label: str, value: int, width: int, base: int, bound: int, inverse: bool) -> int:
        low = base ** (width // 2)
        high = base ** (width - width // 2)
        left, right = divmod(value, low)  # left below high, right below low
        for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if k % 2 == 0:
                left = (left + sign * self._round(label, k, right, bound)) % high
            else:
                right = (right + sign * self._round(label, k, left, bound)) % low
        return left * low + right

    def _permute(self, label: str, value: int, bound: int, inverse: bool = False) -> int:
        """Image of ``value`` (or the value of which it is the image) among the numbers below ``bound``."""
        if bound < 2:
            return value
        width, base = 2, 2
        while base**width < bound:
            width += 1
        while True:
            value = self._once(label, value, width, base, bound, inverse)
            if value < bound:
                return value


def luhn_digit(digits: str) -> str:
    """The digit that completes a number so that it passes the Luhn check."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _refill(pattern: str, digits: str) -> str:
    """The digits in the places of the pattern's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _card(f: Feistel, text: str, inverse: bool) -> str | None:
    """Cards of one length among themselves. Of 16 digits and a blank group more, the 16 are the card if they
    pass the check alone; so longer images are permuted again until their first 16 digits fail it."""
    digits = re.sub("[^0-9]", "", text)
    if not _valid(digits):
        return None
    image = digits
    while True:
        body = image[1:-1]
        image = digits[0] + str(f.permute("card", int(body), 10 ** len(body), inverse)).zfill(len(body))
        image += luhn_digit(image)
        if text.count(" ") < 4 or not _valid(image[:16]):
            return _refill(text, image)


def _phone(f: Feistel, text: str, inverse: bool) -> str:
    head = text.startswith("+1")
    digits = re.sub("[^0-9]", "", text)[1 if head else 0 :]
    value = f.permute("phone", int(digits), 10**10, inverse)
    return _refill(text, ("1" if head else "") + str(value).zfill(10))


def _ipv4(f: Feistel, text: str, inverse: bool) -> str | None:
    """Addresses keep the number of digits of each part, so every image has the format of its value."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    ranges = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
    value, bound = 0, 1
    for p in parts:
        low, size = ranges[len(p)]
        value, bound = value * size + int(p) - low, bound * size
    value = f.permute("ipv4" + "".join(str(len(p)) for p in parts), value, bound, inverse)
    out = []
    for p in reversed(parts):
        low, size = ranges[len(p)]
        value, rest = divmod(value, size)
        out.append(str(rest + low))
    return ".".join(reversed(out))


def _date(f: Feistel, text: str, inverse: bool) -> str | None:
    """Any calendar date from 1900 to 2099; the layout stays."""
    if "-" in text:
        year, month, day = map(int, text.split("-"))
    elif "." in text:
        day, month, year = map(int, text.split("."))
    else:
        month, day, year = map(int, text.split("/"))
    if not (1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    at = f.permute("date", datetime.date(year, month, day).toordinal() - _FIRST_DAY, _DAYS, inverse)
    image = datetime.date.fromordinal(_FIRST_DAY + at)
    return image.strftime("%Y-%m-%d" if "-" in text else "%d.%m.%Y" if "." in text else "%m/%d/%Y")


def _email(f: Feistel, text: str, inverse: bool) -> str:
    """Letters and digits of the local part change among letters of the same case and digits; the domain stays."""
    local, domain = text.rsplit("@", 1)
    kinds = [10 if c.isdigit() else 26 if c.isalpha() else 0 for c in local]
    value, bound = 0, 1
    for c, size in zip(local, kinds, strict=True):
        if size:
            value, bound = value * size + (int(c) if size == 10 else _LETTERS.index(c.lower())), bound * size
    shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", local)))
    value = f.permute(f"email|{shape}|{domain.lower()}", value, bound, inverse)
    out = []
    for c, size in zip(reversed(local), reversed(kinds), strict=True):
        if not size:
            out.append(c)
            continue
        value, rest = divmod(value, size)
        new = str(rest) if size == 10 else _LETTERS[rest]
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out)) + "@" + domain


_MAKERS: dict[str, Callable] = {"email": _email, "card": _card, "phone": _phone, "ipv4": _ipv4, "date": _date}


def pseudonymize(f: Feistel, text: str, inverse: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of the values in the given text."""
    parts, spans, at = [], [], 0
    for m in _ANY.finditer(text):
        new = _MAKERS[kind := m.lastgroup if m.lastgroup != "gap" else "card"](f, m[0], inverse)
        if new is None and kind == "card" and (longer := _LONG.match(text, m.start())):
            m, new = longer, _card(f, longer[0], inverse)
        if new is None:
            continue
        parts += [text[at : m.start()], new]
        spans.append((kind, m.start(), m.end()))
        at = m.end()
    return "".join([*parts, text[at:]]) if parts else text, spans


def replace_personal_data(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False
) -> DataFrame:
    """``doc_id, text, n_<kind> for each kind, spans`` for every row of ``docs``; ``inverse`` takes pseudonyms back.

    Values that fail validation (Luhn check, calendar, octets) stay as they are. A null text
    stays null, without values; null ids stay null; repeated rows give repeated results. Other
    columns are not read; an empty table gives an empty one. The job is one pass without shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            texts, spans, counts = [], [], [[] for _ in KINDS]
            for value in batch.column(1):
                text = value.as_py()
                new, found = (None, []) if text is None else pseudonymize(f, text, inverse)
                texts.append(new)
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
                for kind, count in zip(KINDS, counts, strict=True):
                    count.append(sum(k == kind for k, _, _ in found))
            columns = [batch.column(0), pa.array(texts, pa.string())]
            columns += [pa.array(c, pa.int64()) for c in counts] + [pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"doc_id {kind}, text string, {', '.join(f'n_{k} long' for k in KINDS)}, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

"""Numpy views of Arrow text batches: word bounds, word hashes and hashes of word runs.

Words are runs of bytes other than 0x20 and 0x09-0x0D, so no UTF-8 character is ever cut.
Hashes are polynomials modulo 2**64 over random byte values, mixed at the end; equal
words have equal hashes in every task. Temporary memory is bounded by CHUNK, besides a
few numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BLOCK_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD1342543DE82EF95)
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(CHUNK, _ODD))])
_INVERSE = np.concatenate(
    [[np.uint64(1)], np.cumprod(np.full(CHUNK, np.uint64(pow(int(_ODD), -1, 1 << 64))))]
)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    if len(column) == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row forms its own range."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z turned into a-z."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span data[start:end]; spans are sorted and do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(data), CHUNK):
        stop = min(len(data), at + CHUNK)
        first = int(np.searchsorted(ends, at, "right"))
        last = int(np.searchsorted(starts, stop, "left"))
        if first >= last:
            continue
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data[at:stop]] * _POWERS[: stop - at])])
        s = np.maximum(starts[first:last], at) - at
        e = np.minimum(ends[first:last], stop) - at
        part = (sums[e] - sums[s]) * _INVERSE[s]
        before = at - int(starts[first])
        if before > 0:  # the word began in an earlier chunk
            part[:1] *= np.uint64(pow(int(_ODD), before, 1 << 64))
        out[first:last] += part
    return mix(out ^ (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row number of every word of the rows."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~_WS[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive items (runs across rows included), by doubling."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out, have, power, power_have = None, 0, hashes, 1
    while size > have:
        if (size - have) & power_have:  # runs of the lowest missing power of two go to the right
            if out is None:
                out, have = power, power_have
            else:
                n = len(hashes) - have - power_have + 1
                out = out[:n] * _power(power_have) + power[have : have + n]
                have += power_have
        if size > have:
            n = len(hashes) - 2 * power_have + 1
            if n <= 0:
                break
            power = power[:n] * _power(power_have) + power[power_have : power_have + n]
            power_have *= 2
    return mix(out)


class Sums:
    """Prefix sums of item hashes, for the hash of any run of items; runs may overlap."""

    def __init__(self, hashes: np.ndarray) -> None:
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), _GRAM)]))
        self.inverse = pow(int(_GRAM), -1, 1 << 64)
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), np.uint64(self.inverse))]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the items from ``start`` up to ``end``."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_GRAM), n, 1 << 64))


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        if len(out) <= step:
            return out[:0]
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out

"""Vectorised work on Arrow string columns: words, and 64-bit hashes of any byte span.

The hash of a span is a polynomial over its bytes modulo the prime 2^61 - 1, taken from prefix
sums, so that every span of a slice costs a few array operations. Two different spans of n bytes
meet for at most n of the 2^61 bases; modulo a power of two some pairs would meet for every base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = (1 << 61) - 1
_BASE = 0x1D3A9F4C6B87E25B % _P
_INVERSE = pow(_BASE, -1, _P)
#: The longest span that prefix sums hold without a carry; longer ones are hashed by themselves.
_LONGEST = 1 << 22
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes; null is empty."""
    if len(column) == 0:
        return
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and where each text's words begin."""
    space = SPACE[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[1:], after[:-1] = space[:-1], space[1:]
        before[0] = after[-1] = True
        inner = off[1:-1]
        before[inner[inner < len(data)]] = True
        after[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def _times(x: np.ndarray, y1: np.ndarray, y0: np.ndarray) -> np.ndarray:
    """``x * (y1 * 2^31 + y0)`` modulo 2^61 - 1, by halves; x is at most a little above 2^61."""
    x1, x0 = x >> np.uint64(31), x & np.uint64(0x7FFFFFFF)
    middle = x1 * y0 + x0 * y1
    # 2^62 is 2, and middle * 2^31 is its upper part and its lower 30 bits 31 places up
    out = x1 * y1
    out <<= np.uint64(1)
    out += x0 * y0
    out += middle >> np.uint64(30)
    out += (middle & np.uint64(0x3FFFFFFF)) << np.uint64(31)
    out = (out & np.uint64(_P)) + (out >> np.uint64(61))
    out[out >= np.uint64(_P)] -= np.uint64(_P)
    return out


def _grown(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = pow(base, len(out), _P)
        out = np.concatenate([out, _times(out, np.uint64(step >> 31), np.uint64(step & 0x7FFFFFFF))])
    return out[:n]


def forget() -> None:
    """Frees the powers that ``Spans`` keeps between slices; the next slice makes them anew."""
    _powers.clear()


class Spans:
    """Hashes of spans of ``data``."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data) + 1
        if not _powers or len(_powers[0]) < n:
            size = max(n, SLICE_BYTES + 1)
            power, back = _grown(_BASE, size), _grown(_INVERSE, size)
            _powers[:] = [power & np.uint64(0xFFFFFFFF), power >> np.uint64(32), back >> np.uint64(31), back & np.uint64(0x7FFFFFFF)]
        value = data.astype(np.uint64)
        value += np.uint64(1)
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for sums, power in ((self.low[1:], _powers[0]), (self.high[1:], _powers[1])):
            np.multiply(value, power[: n - 1], out=sums)
            np.cumsum(sums, out=sums)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = self.high[end] - self.high[start], self.low[end] - self.low[start]
        # high * 2^32: what lies above 29 bits comes back at the bottom
        total = (high & np.uint64(0x1FFFFFFF)) << np.uint64(32)
        total += high >> np.uint64(29)
        total += low & np.uint64(_P)
        total += low >> np.uint64(61)
        total = (total & np.uint64(_P)) + (total >> np.uint64(61))
        length = end - start
        out = mix(_times(total, _powers[2][start], _powers[3][start]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(length > _LONGEST):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def distinct_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, the place of one of each, and each value's place among them."""
    order = np.argsort(x)
    ranked = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    distinct, one = ranked[new], order[new]
    del ranked
    rank = np.cumsum(new)
    rank -= 1
    inverse = np.empty(len(x), np.int64)
    inverse[order] = rank
    return distinct, one, inverse

"""Words of a text and polynomial hashes modulo 2 ** 64 of runs of them, by array operations."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd multiplier of the polynomial hash over bytes.
BYTE = np.uint64(0x9E3779B97F4A7C15)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were asked for."""

    def __init__(self, base: np.uint64):
        self.bases = [int(base), pow(int(base), -1, 2**64)]
        self.tables = [np.ones(1, dtype=np.uint64)] * 2

    def get(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            n = 1 << n.bit_length()
            self.tables = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, dtype=np.uint64)], dtype=np.uint64) for b in self.bases]
        return self.tables


_POWERS: dict[int, _Powers] = {}


def range_hashes(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each range, by prefix sums modulo 2 ** 64; the lengths go in as well."""
    power, inverse = _POWERS.setdefault(int(base), _Powers(base)).get(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=prefix[1:])
    return scramble((prefix[ends] - prefix[starts]) * inverse[starts] + scramble((ends - starts).astype(np.uint64) + base))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text with the starts and ends of its words, the runs of other bytes than 0x20 and 0x09 to 0x0D."""
    b = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    step = np.diff(inside)
    return b, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes) -> np.ndarray:
    b, starts, ends = word_spans(text)
    return range_hashes(b.astype(np.uint64) + np.uint64(1), BYTE, starts, ends)


def window_hashes(words: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    at = np.arange(n)
    return range_hashes(words, base, at, at + size)

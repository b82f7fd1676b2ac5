"""Hashes of substrings and word runs, computed with numpy over whole texts.

A text's prefix sums S[i] = sum(T[b_j] * B**j for j < i) modulo 2**64 give the
hash of any substring in constant time: (S[j] - S[i]) * B**-i.  T maps bytes to
random odd numbers.  Hashes are stable between processes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << (n - 1).bit_length(), 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Substrings:
    """Constant-time substring hashes of one byte string, in one of two families
    that have nothing in common."""

    def __init__(self, data: np.ndarray, family: int = 0):
        up, self._down = _power_tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[family][data] * up[: len(data)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of data[start:end]; the lengths take part."""
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def windows(self, width: int) -> np.ndarray:
        """Of all substrings of that width, from the left."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (self._sums[width:] - self._sums[:n]) * self._down[:n]
        return mix(raw + np.uint64(width * 0xA24BAED4963EE407 % 2**64))


#: ASCII white space separates words: tab to carriage return, and the space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str) -> np.ndarray:
    """One hash for each word of the lower-cased text."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = words(data)
    return Substrings(data).hashes(starts, ends)


def shingle_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words; a shorter, non-empty text is one run."""
    if not len(word):
        return np.zeros(0, np.uint64)
    n = max(1, len(word) - k + 1)
    out = np.full(n, len(word) if len(word) < k else k, np.uint64)
    for j in range(min(k, len(word))):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + word[j : j + n])
    return out


def _sliding(best: np.ufunc, fill: int, values: np.ndarray, width: int) -> np.ndarray:
    """best of every run of width values, from the left."""
    n = len(values)
    blocks = -(-n // width)
    table = np.full(blocks * width, fill, np.uint64)
    table[:n] = values
    table = table.reshape(blocks, width)
    before = best.accumulate(table, axis=1).ravel()
    after = best.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the minimum of at least one run of width values (of
    all values if there are fewer); equal minima all count."""
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    width = min(width, n)
    top = np.iinfo(np.uint64).max
    least = _sliding(np.minimum, top, values, width)
    # position i lies in the runs i-width+1 .. i; pad the runs that do not exist
    padded = np.zeros(n + width - 1, np.uint64)
    padded[width - 1 : n] = least
    return np.flatnonzero(_sliding(np.maximum, 0, padded, width) == values)

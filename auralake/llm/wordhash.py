"""Vectorised hashes of words and word shingles of many texts at once (numpy, no loop over words).

A word is a run of letters, digits or non-ASCII bytes, folded to lower case for ASCII and Latin-1
letters. Its hash is a difference of prefix sums of a polynomial modulo 2**64, shifted to the word's
start by the inverse power, then mixed.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MULTIPLIERS = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) for j in range(16)], np.uint64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = True
_WORD[128:] = True
_powers = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, kept between calls."""
    if _powers["n"] < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for key, base in (("p", BASE), ("q", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["p"][:n], _powers["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of Latin-1 letters in UTF-8 (C3 80..9E but 97)."""
    low = _LOWER[data]
    if len(low) > 1:
        up = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[:-1] == 0xC3) & (low[1:] != 0x97)) + 1
        low[up] += 32
    return low


def word_spans(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (n + 1 entries)."""
    n = len(low)
    inside = np.zeros(n + 1, bool)
    inside[:n] = _WORD[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    begins[firsts] = inside[firsts]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside[:-1] & ~inside[1:]
    ends = offs[1:][offs[:-1] < offs[1:]]
    stop[ends] |= inside[ends - 1]
    starts = np.flatnonzero(begins[:n])
    return starts, np.flatnonzero(stop), np.searchsorted(starts, offs)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of low[s:e]; equal bytes have equal hashes wherever they stand."""
    n = len(low)
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and their bounds by text.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    m = len(words)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    counts = np.diff(bounds)
    end = np.repeat(bounds[1:], counts)
    at = np.arange(m)
    total = np.zeros(m, np.uint64)
    for j in range(min(size, m)):
        total[: m - j] += np.where(at[: m - j] + j < end[: m - j], words[j:] * MULTIPLIERS[j], np.uint64(0))
    keep = at + size <= end
    short = counts < size
    keep[bounds[:-1][short & (counts > 0)]] = True
    per_text = np.where(short, np.minimum(counts, 1), counts - size + 1)
    out = np.zeros(len(bounds), np.int64)
    np.cumsum(per_text, out=out[1:])
    return mix(total[keep]), out


def text_shingles(data: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word bounds, shingle hashes, shingle bounds) of the texts in data."""
    low = fold(data)
    starts, ends, bounds = word_spans(low, offs)
    words = span_hashes(low, starts, ends)
    found, at = shingles(words, bounds, size)
    return words, bounds, found, at

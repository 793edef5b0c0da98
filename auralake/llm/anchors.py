"""Anchors of byte strings: places that equal strings of `least` bytes choose alike, wherever they stand.

Among the runs of `gram` bytes that start in a window of `least` bytes the one of the least hash is
the window's anchor, the first of them on a tie. A window's anchor depends on its bytes alone, so equal
windows have equal anchors at equal distances, and each window has exactly one.
"""

from __future__ import annotations

import numpy as np

from auralake.llm.wordhash import mix, powers


class Sums:
    """Prefix sums of a byte string, from which the hash of any slice follows."""

    def __init__(self, data: np.ndarray):
        self.p, self.q = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.p[: len(data)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all runs of n bytes."""
        return mix((self.sums[n:] - self.sums[: len(self.sums) - n]) * self.q[: len(self.sums) - n])

    def slices(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mix(((self.sums[ends] - self.sums[starts]) * self.q[starts]) ^ mix(salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525351)
_steps: dict[tuple[int, int], np.ndarray] = {}


def _prime_powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**i modulo prime for i < n, kept between calls and doubled as needed."""
    got = _steps.get((base, prime), np.ones(1, np.uint64))
    while len(got) < n:
        got = np.concatenate([got, got * np.uint64(pow(base, len(got), prime)) % np.uint64(prime)])
    _steps[base, prime] = got
    return got[:n]


class Checks:
    """A second hash of slices: two polynomials modulo primes of 31 bits, independent of Sums and of its modulus."""

    def __init__(self, data: np.ndarray):
        self.lanes = []
        for base, prime in zip(_BASES, PRIMES, strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _prime_powers(base, prime, len(data)) % np.uint64(prime), out=sums[1:])
            self.lanes.append((sums, _prime_powers(pow(base, -1, prime), prime, len(data) + 1), np.uint64(prime)))

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62 bits of each slice."""
        high, low = ((sums[ends] - sums[starts]) % prime * back[starts] % prime for sums, back, prime in self.lanes)
        return (high << np.uint64(31) | low).view(np.int64)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For every i the least of h[i : i + width], by doubling."""
    m, span = h, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :]) if span < width else m


def anchors(sums: Sums, offs: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor its place, its hash, and the first and last start of the windows that have it."""
    width, n = least - gram + 1, len(sums.sums) - 1
    if n < least:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    h = sums.grams(gram)
    low = window_minima(h, width)
    edge = np.zeros(n + 1, np.int32)
    fit = np.diff(offs) >= least
    np.add.at(edge, offs[:-1][fit], 1)
    np.add.at(edge, offs[1:][fit] - least + 1, -1)
    own = np.flatnonzero(np.cumsum(edge[: len(low)]) > 0)
    if not len(own):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # Runs of adjacent windows of one least hash, then cut where a run passes its anchor: the next one
    # is a repeat of the same gram further on.
    change = np.ones(len(own), bool)
    change[1:] = (low[own[1:]] != low[own[:-1]]) | (own[1:] != own[:-1] + 1)
    first = np.flatnonzero(change)
    heads, lasts = own[first], own[np.append(first[1:], len(own)) - 1]
    value, out, reach = low[heads], [], np.arange(width)
    while len(heads):
        at = np.empty(len(heads), np.int64)
        for i in range(0, len(heads), 4096):
            some = slice(i, i + 4096)
            at[some] = heads[some] + (h[heads[some][:, None] + reach] == value[some][:, None]).argmax(1)
        out.append((at, value, heads, np.minimum(lasts, at)))
        more = lasts > at
        heads, lasts, value = at[more] + 1, lasts[more], value[more]
    place, hashes, lo, hi = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(lo, kind="stable")
    return place[order], hashes[order], lo[order], hi[order]

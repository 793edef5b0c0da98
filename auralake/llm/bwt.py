"""Equal strings of `least` bytes by threshold-bounded interval expansion on a Burrows-Wheeler transform.

The suffixes of a text are sorted by their first bytes, `least` and a few more, which is as much order
as intervals of shorter strings need. Then, breadth first, the interval of every string is extended to
the left by each symbol that precedes it: the end of a new interval is a place where the common prefix
of two neighbours is as long as the level. So common prefixes come in increasing order, each is set
once, and the expansion stops at `least`: where nothing is set, neighbours share `least` bytes or more.
"""

from __future__ import annotations

import numpy as np


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of x ordered by their first `depth` symbols or more: as many as fit into a number, then by ranks, three at once or two."""
    n, bits = len(x), max(1, int(x.max()).bit_length())
    k, width = max(1, 63 // bits), n.bit_length()
    padded = np.concatenate([x.astype(np.uint64), np.zeros(k, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key = key << np.uint64(bits) | padded[j : j + n]
    while True:
        order = np.argsort(key)  # ties have no order: what is alike that far is in one interval
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if k >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new + 1
        key, times = rank.astype(np.uint64), 3 if 3 * width <= 64 else 2
        for j in range(1, times):
            key <<= np.uint64(width)
            key[: max(0, n - j * k)] |= rank[j * k :].astype(np.uint64)
        k *= times


def expand(x: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether the suffixes order[i - 1] and order[i] differ within `least` symbols (n + 1 places, true at both ends)."""
    n = len(x)
    bwt = x[order - 1]  # the symbol before a suffix; the last one before the first
    by_symbol = np.argsort(bwt.astype(np.uint16) if x.max() < 1 << 16 else bwt, kind="stable")  # numbers of 16 bits are sorted by their digits
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    before, after = np.full(n, -1), np.full(n, n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    ends = np.zeros(n + 1, bool)
    ends[0] = ends[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(least):
        if not len(lo):
            break
        sizes = hi - lo
        of = np.repeat(np.arange(len(lo)), sizes)
        at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[of]
        # The first and the last of each symbol in an interval bound the interval of that symbol before it.
        first, last = before[at] < lo[of], after[at] >= hi[of]
        # Intervals of different strings of one length are apart, so in order their starts and ends are those of the same ones.
        a, b = np.sort(lf[at[first]]), np.sort(lf[at[last]]) + 1
        new = ~ends[b]
        a, b = a[new], b[new]
        ends[b] = True
        lo, hi = a, b
    return ends


def repeated(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of strings of `least` symbols that occur more than once in x, and the group each belongs to."""
    if len(x) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = suffix_order(x, least + 2)
    ends = expand(x, order, least)
    group = np.cumsum(ends[:-1])
    alone = ends[:-1] & ends[1:]
    return order[~alone], group[~alone]

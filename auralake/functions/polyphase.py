"""Resampling by a polyphase filter bank, in blocks: the windowed sinc of signal.resample_array in constant memory.

With up / down the ratio of the rates in lowest terms, output i lies at input i * down // up with a phase of
i * down % up, of which there are `up`. The kernel at each phase is one row of a bank; a block of outputs is
the inputs around each of them times the rows of their phases. A block needs the inputs it spans and `reach` more on
either side, so blocks are independent: within a waveform they follow one another, and of a waveform
that is kept in pieces over rows each block is a task's own.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Zero crossings of the kernel on either side, and how much of the narrower band is kept.
HALF, BAND = 16, 0.99
#: Outputs that are computed at once, and outputs of a block over rows.
BLOCK, ROW_BLOCK = 4096, 1 << 16


def reach_of(rate: int, to: int) -> int:
    """Inputs on either side that an output depends on."""
    return int(ceil(HALF / (min(1.0, to / rate) * BAND)))


@lru_cache(maxsize=64)
def bank(up: int, down: int) -> np.ndarray:
    """up rows of 2 * reach + 1 values: the kernel at each phase."""
    band, reach = min(1.0, up / down) * BAND, reach_of(down, up)
    gap = np.arange(up)[:, None] / up - np.arange(-reach, reach + 1)
    return band * np.sinc(band * gap) * np.cos(np.clip(gap / reach, -1, 1) * np.pi / 2) ** 2


def outputs(x: np.ndarray, offset: int, first: int, n: int, rate: int, to: int) -> np.ndarray:
    """Outputs first to first + n - 1 of a waveform of which x is what lies from `offset` on; beyond x it is silent."""
    g = gcd(rate, to)
    up, down = to // g, rate // g
    rows, reach, out = bank(up, down), reach_of(down, up), np.empty(n)
    for a in range(0, n, BLOCK):
        i = first + np.arange(a, min(a + BLOCK, n), dtype=np.int64)
        at = i * down // up - reach - offset
        low, high = int(at[0]), int(at[-1]) + 2 * reach + 1
        held = np.zeros(high - low)
        s, e = max(low, 0), min(high, len(x))
        if s < e:
            held[s - low : e - low] = x[s:e]
        windows = np.lib.stride_tricks.sliding_window_view(held, 2 * reach + 1)[at - low]
        out[a : a + len(i)] = np.einsum("ij,ij->i", windows, rows[i * down % up])
    return out


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """One channel at another rate, ceil(n * to / rate) samples; beside input and output a block is held."""
    if rate == to or not len(x):
        return np.asarray(x, np.float64)
    return outputs(np.asarray(x), 0, 0, -(-len(x) * to // rate), rate, to)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _block(x: pd.Series, offset: pd.Series, first: pd.Series, n: pd.Series, rate: pd.Series, to: pd.Series) -> pd.Series:
    rows = zip(x, offset, first, n, rate, to, strict=True)
    return pd.Series([np.asarray(v, float)[int(f - o) : int(f - o + m)] if r == t else outputs(np.asarray(v, float), int(o), int(f), int(m), int(r), int(t)) for v, o, f, m, r, t in rows])


def resample_pieces(rows: DataFrame, key: str, piece: str, wave: str, rate: str, to: int, block: int = ROW_BLOCK) -> DataFrame:
    """key, piece (from 0) and wave of waveforms at rate `to`, each given and given back in pieces over rows.

    A waveform's pieces follow one another in the order of `piece`, whatever their sizes; its rate is the same in all.
    Each piece goes, cut to what is needed, to the blocks of outputs that depend on it, its halo included; a block is one row
    of `block` samples, so a waveform of any length is spread over as many tasks as it has blocks. Pieces that
    are null or empty add nothing; a waveform without samples has no rows.
    """
    own = rows.select(F.col(key).alias("key"), F.col(piece).alias("piece"), F.col(wave).cast("array<double>").alias("w"), F.col(rate).cast("long").alias("rate")).where(F.size("w") > 0)
    # Where each piece begins is found from sizes alone.
    sizes, order = own.select("key", "piece", F.size("w").cast("long").alias("m")), Window.partitionBy("key").orderBy("piece")
    starts = sizes.select("key", "piece", (F.sum("m").over(order) - F.col("m")).alias("s"), F.sum("m").over(Window.partitionBy("key")).alias("total"))
    starts = starts.withColumnsRenamed({"key": "k", "piece": "p"})
    placed = own.join(starts, F.col("key").eqNullSafe(F.col("k")) & (F.col("piece") == F.col("p"))).drop("k", "p")
    target, size = F.lit(to).cast("long"), F.lit(block).cast("long")
    reach = F.when(F.col("rate") == target, 0).otherwise(F.ceil(HALF / (F.least(F.lit(1.0), target / F.col("rate")) * BAND))).cast("long")
    whole = F.floor((F.col("total") * target + F.col("rate") - 1) / F.col("rate")).cast("long")
    placed = placed.withColumns({"reach": reach, "outs": whole, "m": F.size("w").cast("long")})
    # Outputs i with i * rate / to within reach of the piece, and one more on either side.
    low = F.greatest(F.floor((F.col("s") - F.col("reach") - 2) * target / F.col("rate")), F.lit(0)).cast("long")
    high = F.least(F.ceil((F.col("s") + F.col("m") + F.col("reach") + 2) * target / F.col("rate")), F.col("outs") - 1).cast("long")
    dealt = placed.withColumn("block", F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))
    first = F.col("block") * size
    n = F.least(size, F.col("outs") - first)
    begin = F.floor(first * F.col("rate") / target).cast("long") - F.col("reach") - 1
    end = F.floor((first + n - 1) * F.col("rate") / target).cast("long") + F.col("reach") + 2
    left = F.greatest(begin - F.col("s"), F.lit(0))
    part = F.slice("w", (left + 1).cast("int"), F.greatest(F.least(end - F.col("s"), F.col("m")) - left, F.lit(0)).cast("int"))
    met = dealt.select("key", "block", "rate", first.alias("first"), n.alias("n"), F.struct((F.col("s") + left).alias("at"), part.alias("x")).alias("part")).where(F.size("part.x") > 0)
    joined = met.groupBy("key", "block", "rate", "first", "n").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    made = _block(F.flatten(F.transform("parts", lambda p: p["x"])), F.get("parts", 0)["at"], F.col("first"), F.col("n"), F.col("rate"), F.lit(to))
    return joined.select(F.col("key").alias(key), F.col("block").alias(piece), made.alias(wave))

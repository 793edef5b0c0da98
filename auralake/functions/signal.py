"""Scalars over vectors and waveforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.functions.arrays import let
from auralake.functions.polyphase import resampled


def peak_normalize(wave: Column, decibel: float = -1.0) -> Column:
    """One channel scaled to a peak of 10 ** (decibel / 20); null for silence."""
    peak = lambda a: F.array_max(F.transform(a, lambda x: F.abs(x)))
    return let(wave, lambda a: let(F.struct(a.alias("a"), (F.pow(F.lit(10.0), F.lit(decibel / 20)) / F.nullif(peak(a), F.lit(0.0))).alias("g")), lambda s: F.when(s["g"].isNotNull(), F.transform(s["a"], lambda x: x * s["g"]))))


def mix_vectors(a: Column, b: Column, weight: Column) -> Column:
    """weight * a + (1 - weight) * b in doubles."""
    w = weight.cast("double")
    return let(F.struct(a.alias("a"), b.alias("b"), w.alias("w")), lambda s: F.zip_with(s["a"], s["b"], lambda x, y: s["w"] * x.cast("double") + (1 - s["w"]) * y.cast("double")))


def codes(vector: Column, size: int = 2048, scale: float = 1e4) -> Column:
    """A vector's components as codes below size."""
    return F.transform(vector, lambda x: F.pmod(F.floor(x.cast("double") * scale).cast("int"), F.lit(size)))


def histogram_bin(value: Column, lo: Column, hi: Column, bins: int = 10) -> Column:
    """0 to bins - 1; the last bin holds hi; one bin if lo = hi."""
    return F.when(lo == hi, 0).otherwise(F.least(F.floor((value - lo) / (hi - lo) * bins), F.lit(bins - 1))).cast("int")


def speed(tokens: Column, seconds: Column) -> Column:
    """Tokens a second; null for no time."""
    return F.try_divide(tokens.cast("double"), seconds.cast("double"))


def resample_array(x: np.ndarray, rate: int, to: int, half: int = 16) -> np.ndarray:
    """Windowed-sinc resampling of one channel to ceil(n * to / rate) samples, all at once: what polyphase is held against."""
    if rate == to or not len(x):
        return x.astype(np.float64)
    n, band = -(-len(x) * to // rate), min(1.0, to / rate) * 0.99
    where = np.arange(n) * (rate / to)
    reach = int(np.ceil(half / band))
    at = np.floor(where).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
    gap = where[:, None] - at
    kernel = band * np.sinc(band * gap) * np.cos(np.clip(gap / reach, -1, 1) * np.pi / 2) ** 2
    known = (at >= 0) & (at < len(x))
    return (np.where(known, x[np.clip(at, 0, len(x) - 1)], 0) * kernel).sum(1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resample(wave: pd.Series, rate: pd.Series, to: pd.Series) -> pd.Series:
    """One channel at another rate, by a filter bank in blocks: the values of resample_array."""
    return pd.Series([None if x is None else resampled(np.asarray(x, float), int(a), int(b)) for x, a, b in zip(wave, rate, to, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit_variance(wave: pd.Series) -> pd.Series:
    """Zero mean and unit variance: what speech feature extractors expect at 16 kHz."""
    return pd.Series([None if x is None else (np.asarray(x, float) - np.mean(x)) / np.sqrt(np.var(x) + 1e-7) if len(x) else x for x in wave])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_of(payload: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a binary payload, as unbase64() gives it."""
    return pd.Series([None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4") for b in payload])

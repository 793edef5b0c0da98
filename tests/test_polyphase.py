import tracemalloc

import numpy as np
import pytest

from auralake.functions import polyphase as pp
from auralake.functions.signal import resample_array

RATES = [(16_000, 24_000), (48_000, 24_000), (44_100, 24_000), (24_000, 44_100), (8_000, 48_000), (22_050, 16_000), (24_000, 24_000), (7, 3), (44_101, 24_000)]


@pytest.mark.parametrize("rate, to", RATES)
@pytest.mark.parametrize("n", [0, 1, 5, 33, 9_001])
def test_equals_the_kernel_at_once(rate, to, n):
    x = np.random.default_rng(n).normal(size=n)
    got, want = pp.resampled(x, rate, to), resample_array(x, rate, to)
    assert len(got) == len(want) == -(-n * to // rate) and (not n or np.abs(got - want).max() < 1e-9)


def test_memory_is_that_of_a_block():
    peaks = []
    for n in (50_000, 2_000_000):
        x = np.random.default_rng(1).normal(size=n)
        pp.resampled(x[:100], 48_000, 24_000)
        tracemalloc.start()
        pp.resampled(x, 48_000, 24_000)
        peaks.append(tracemalloc.get_traced_memory()[1] - n // 2 * 8)  # less the output
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 100_000


@pytest.mark.parametrize("rate, to", [(48_000, 24_000), (16_000, 24_000), (44_100, 16_000), (24_000, 24_000)])
def test_pieces_over_rows_equal_the_whole(spark, rate, to):
    rng, rows, waves = np.random.default_rng(rate), [], {}
    for key, n in (("a", 5_000), ("b", 1), ("c", 1_700), (None, 300)):
        x = waves[key] = rng.normal(size=n)
        cuts = np.sort(rng.integers(0, n + 1, 12))  # some pieces are empty, some shorter than the halo
        rows += [(key, 10 * i, p.tolist(), rate) for i, p in enumerate(np.split(x, cuts))]
    rows += [("none", 0, [], rate), ("a", 3, None, rate)]
    df = spark.createDataFrame(rows, "k string, at int, wave array<double>, rate int").repartition(3)
    out = pp.resample_pieces(df, "k", "at", "wave", "rate", to, block=256).collect()
    for key, x in waves.items():
        own = sorted((r for r in out if r.k == key), key=lambda r: r.at)
        assert [r.at for r in own] == list(range(len(own))) and all(len(r.wave) == 256 for r in own[:-1])
        got, want = np.concatenate([r.wave for r in own]), resample_array(x, rate, to)
        assert len(got) == len(want) and np.abs(got - want).max() < 1e-9
    assert {r.k for r in out} == set(waves)

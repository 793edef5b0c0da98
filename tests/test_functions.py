import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auralake.config import VOCABULARY, session
from auralake.functions import arrays, logits, signal, text, tokens
from auralake.operators import chunking, metrics

HISTORIES = [([], 0), ([1], 1), ([1, 2], 2), ([1, 2, 3], 3), ([1, 2, 3, 4], 0)]


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


def test_vocabulary_adds_up():
    v = VOCABULARY
    assert (v.audio_offset, v.audio_size, v.spare) == (50257, 16384, 3375)


@pytest.mark.parametrize("past, book", HISTORIES)
@pytest.mark.parametrize("stop", [-1, [9999]])
def test_mask_keeps_the_book_whose_turn_it_is(spark, past, book, stop):
    values = np.random.default_rng(1).normal(size=10_000)
    df = spark.createDataFrame([(values.tolist(), len(past))], "l array<double>, n int")
    out = np.array(df.select(logits.mask_other_books(F.col("l"), F.col("n"), 4, 2048, 100, stop)).first()[0])
    keep = np.zeros(10_000, bool)
    keep[100 + book * 2048 : 100 + (book + 1) * 2048] = True
    keep[9999] = True
    assert out.shape == (10_000,)
    assert np.array_equal(out[keep], values[keep])
    assert np.all(np.isneginf(out[~keep]))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 6), st.integers(0, 2**32 - 1))
def test_decode_undoes_encode(spark, frames, seed):
    m = np.random.default_rng(seed).integers(0, 2048, (8, frames)).tolist()
    df = spark.createDataFrame([(m,)], "m array<array<int>>")
    flat = df.select(tokens.encode_audio(F.col("m")).alias("f"), tokens.decode_audio(tokens.encode_audio(F.col("m"))).alias("back")).first()
    assert flat["back"] == m
    assert flat["f"] == [50257 + 2048 * c + m[c][t] for t in range(frames) for c in range(8)]


@pytest.mark.parametrize("ids, frames", [([], 0), ([1] * 7, 0), ([1] * 8, 1), ([1] * 17, 2)])
def test_incomplete_frames_are_left_out(spark, ids, frames):
    df = spark.createDataFrame([(ids,)], "a array<int>")
    out = df.select(tokens.decode_audio(F.col("a")).alias("m")).first()["m"]
    assert [len(r) for r in out] == [frames] * 8


@pytest.mark.parametrize("n, most, overlap", [(0, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 1), (7, 4, 1), (10, 4, 0), (23, 6, 2), (64, 16, 4)])
def test_chunks_equal_a_loop(spark, n, most, overlap):
    a, want, at = list(range(n)), [], 0
    while at < n:
        want.append(a[at : at + most])
        if at + most > n:
            break
        at += most - overlap
    df = spark.createDataFrame([(a,)], "a array<int>")
    got = df.select(chunking.chunks(F.col("a"), most, overlap).alias("c")).first()["c"]
    assert got == want
    assert sorted({x for c in got for x in c}) == a


@pytest.mark.parametrize("s", ["", " a ", "\xa0x\xa0", "\x1cx\x1f", "　y", "\r\nz", "a b"])
def test_strip_is_pythons(spark, s):
    assert spark.createDataFrame([(s,)], "t string").select(text.strip(F.col("t"))).first()[0] == s.strip()


def test_sanitize(spark):
    rows = {"a,.?b..c!!": "a?b.c!!", "a\t\tb": "a b", "\n\nA\r\nB ": "a\r b", "": ""}
    for given_, want in rows.items():
        assert spark.createDataFrame([(given_,)], "t string").select(text.sanitize(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("a, n, want", [([1, 2, 3], 0, [1, 2, 3]), ([1, 2, 3], 2, [2, 3]), ([1], 5, [1]), ([], 2, [])])
def test_tail_is_pythons(spark, a, n, want):
    assert spark.createDataFrame([(a,)], "a array<int>").select(arrays.tail(F.col("a"), n)).first()[0] == want


def test_collapse_is_idempotent(spark):
    for a in ([], [1], [2, 2, 2], [1, 2, 1, 2], [1, 1, 2, 2, 1]):
        df = spark.createDataFrame([(a,)], "a array<int>")
        once = df.select(tokens.collapse_runs(F.col("a")).alias("a"))
        assert once.first()[0] == [x for i, x in enumerate(a) if not i or x != a[i - 1]]
        assert once.select(tokens.collapse_runs(F.col("a"))).first()[0] == once.first()[0]


@pytest.mark.parametrize("wave, peak", [([0.5, -2.0, 1.0], 10 ** (-1 / 20)), ([-0.1], 10 ** (-1 / 20))])
def test_peak(spark, wave, peak):
    out = spark.createDataFrame([(wave,)], "w array<double>").select(signal.peak_normalize(F.col("w"))).first()[0]
    assert math.isclose(max(map(abs, out)), peak, rel_tol=1e-12)


def test_silence_has_no_gain(spark):
    assert spark.createDataFrame([([0.0, 0.0],)], "w array<double>").select(signal.peak_normalize(F.col("w"))).first()[0] is None


def test_array_functions_stay_linear(spark):
    import time

    df = spark.createDataFrame([([float(i % 7) for i in range(40_000)],)], "w array<double>").cache()
    df.count()
    for f in (lambda a: signal.peak_normalize(a), lambda a: logits.softmax(a), lambda a: logits.keep_top(a, 15), lambda a: tokens.collapse_runs(F.transform(a, lambda x: x + 1))):
        t = time.time()
        assert df.select(F.size(f(F.col("w")))).first()[0] > 0
        assert time.time() - t < 20


def test_resample_keeps_a_tone_and_the_length():
    rate, n = 16_000, 8_000
    x = np.sin(2 * np.pi * 440 * np.arange(n) / rate)
    y = signal.resample_array(x, rate, 24_000)
    assert len(y) == math.ceil(n * 24_000 / rate)
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / 24_000)
    assert np.abs(y - want)[100:-100].max() < 0.03
    assert np.array_equal(signal.resample_array(x, rate, rate), x)


def test_signal_udfs(spark):
    df = spark.createDataFrame([([0.0, 1.0, 0.0, -1.0] * 50, 16_000, 24_000)], "w array<double>, a int, b int")
    assert df.select(F.size(signal.resample("w", "a", "b"))).first()[0] == 300
    out = np.array(df.select(signal.unit_variance("w")).first()[0])
    assert abs(out.mean()) < 1e-9 and abs(out.std() - 1) < 1e-3
    payload = np.array([1.5, -2.0], "<f4").tobytes()
    back = spark.createDataFrame([(payload,)], "b binary").select(signal.floats_of(F.unbase64(F.base64("b")))).first()[0]
    assert back == [1.5, -2.0]


def test_draw_and_softmax(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.7], 0.05), ([0.1, 0.2, 0.7], 0.15), ([0.1, 0.2, 0.7], 0.9999999)], "p array<double>, u double")
    assert [r[0] for r in df.select(logits.draw(F.col("p"), F.col("u"))).collect()] == [0, 1, 2]


def test_small_operators(spark):
    rows = spark.range(10).withColumn("a", F.sequence(F.lit(1), F.lit(3)))
    assert metrics.seeded_sample(rows, "id", 3).count() == 3
    assert [r.id for r in metrics.seeded_sample(rows, "id", 2).collect()] == [r.id for r in metrics.seeded_sample(rows.repartition(3), "id", 2).collect()]
    assert all(r[0] in (1, 2, 3) for r in rows.select(metrics.pick(F.col("a"), F.col("id"))).collect())
    assert spark.range(1).select(metrics.pick(F.array().cast("array<int>"), F.col("id"))).first()[0] is None
    wave = spark.createDataFrame([([[1.0] * 30, [2.0] * 30],)], "w array<array<double>>")
    assert [len(c) for c in wave.select(arrays.crop_seconds(F.col("w"), 4, 5)).first()[0]] == [20, 20]
    assert spark.createDataFrame([([[1, 2], [3, 4]],)], "m array<array<int>>").select(tokens.join_books(F.col("m"), tokens.narrow(F.col("m")))).first()[0] == [[1, 2, 1, 2], [3, 4, 3, 4]]
    assert session() is not None


def test_odd_length(spark):
    rows = spark.createDataFrame([([],), ([1],), ([1, 2],), (None,)], "a array<int>")
    assert [r[0] for r in rows.select(arrays.odd_length(F.col("a"))).collect()] == [False, True, False, None]

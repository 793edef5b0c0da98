"""Whole queries of the classifiers against plain loops: from a text's bytes to its score, for every document of a table."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm import language, learn, quality, toxicity
from auralake.llm.common import table
from auralake.llm.wordhash import BASE

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def folded(text):
    """ASCII and Latin-1 letters in lower case, byte by byte."""
    raw = bytearray((text or "").encode())
    before = 0
    for i, b in enumerate(raw):
        if 65 <= b <= 90:
            raw[i] = b + 32
        elif before == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            raw[i] = b + 32
        before = b
    return bytes(raw)


def is_word(b):
    return 48 <= b <= 57 or 97 <= b <= 122 or b >= 128


def words(low):
    out, now = [], b""
    for b in low:
        if is_word(b):
            now += bytes([b])
        elif now:
            out.append(now)
            now = b""
    return [*out, now] if now else out


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def word_hash(w):
    return mix((sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(w)) + len(w)) & M64)


def toxic_terms(text):
    out = set()
    for w in words(folded(text)):
        hashes = [word_hash(w)] + [word_hash(w[:n]) * (2 * n + 1) & M64 if len(w) > n else word_hash(w) for n in toxicity.PREFIXES]
        out |= {h >> 64 - toxicity.BITS for h in hashes}
    return sorted(out)


def quality_grams(text):
    raw = (text or "").encode()
    out = {(raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % 2**32 >> 32 - quality.BITS for i in range(len(raw) - 2)}
    found = words(folded(text))
    return sorted(out | ({quality.TWICE} if any(a == b for a, b in zip(found, found[1:])) else set()))


def language_runs(text):
    low = b" " + bytes(b if is_word(b) else 32 for b in folded(text)) + b" "
    out = []
    for run, factor in ((3, 2654435761), (4, 2246822519)):
        out += [int.from_bytes(low[i : i + run], "little") * factor % 2**32 >> 32 - language.BITS for i in range(len(low) - run + 1)]
    return out


def fold(id, folds):
    return zlib.crc32(str(id).encode()) % folds


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def test_toxicity(spark, docs):
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect() if r.toxic is not None}
    taught = [(toxic_terms(docs[i].text), y) for i, y in labels.items() if i in docs and fold(i, 5)]
    taught = [(np.array(r, "<i4"), y) for r, y in taught if r]
    taught.sort(key=lambda p: (learn.hash_bytes(p[0].tobytes()), str(p[1])))
    m = toxicity.fit([r for r, _ in taught], np.array([y for _, y in taught], float))
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        own = [k for k in toxic_terms(d.text) if m.scale[k] > 0]
        size = math.sqrt(sum(float(m.scale[k]) ** 2 for k in own))
        margin = m.w0
        if own:
            x = np.array([float(m.scale[k]) / size for k in own])
            wv = m.wv[own].astype(float)
            margin += x @ wv[:, 0] + sum(((x @ wv[:, j]) ** 2 - (x**2 @ wv[:, j] ** 2)) / 2 for j in range(1, toxicity.RANK + 1))
        score = 1 / (1 + math.exp(-(m.a * margin + m.b)))
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].held_out == (fold(i, 5) == 0) and got[i].predicted == (got[i].score >= 0.5)


def test_quality(spark, docs):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.quality is not None}
    taught = [(np.array(quality_grams(docs[i].text), "<i4"), y) for i, y in labels.items() if i in docs and fold(i, 4) != 2]
    taught = sorted(((r, y) for r, y in taught if len(r)), key=lambda p: (learn.hash_bytes(p[0].tobytes()), str(p[1])))
    m = quality.fit([r for r, _ in taught], np.array([y for _, y in taught], float))
    got = {r.doc_id: r for r in quality.op7_quality(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        own = quality_grams(d.text)
        margin = m.bias + (sum(float(m.rw[k]) for k in own) / math.sqrt(len(own)) if own else 0)
        score = 1 / (1 + math.exp(-(m.a * margin + m.b)))
        assert got[i].score == pytest.approx(score, abs=1e-9) and got[i].held_out == (fold(i, 4) == 2) and got[i].predicted == (got[i].score >= 0.7)


def test_language(spark, docs):
    taught = []
    for i, d in docs.items():
        if fold(i, 4) != 2 and d.lang is not None and d.text is not None:
            own, n = np.unique(language_runs(d.text), return_counts=True)
            if len(own):
                taught.append((own.astype("<i4"), n, d.lang))
    taught.sort(key=lambda p: (learn.hash_bytes(p[0].tobytes()), p[2]))
    m = language.fit([r for r, _, _ in taught], [n for _, n, _ in taught], [y for _, _, y in taught])
    got = {r.doc_id: r for r in language.op9_language(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, d in docs.items():
        own = language_runs(d.text)
        z = [(sum(float(m.weights[k, c]) for k in own) / len(own) + m.bias[c]) / m.temperature for c in range(len(m.langs))]
        p = [math.exp(v - max(z)) for v in z]
        if any(c.isalpha() for c in d.text or ""):
            assert got[i].lang_pred == m.langs[p.index(max(p))] and got[i].score == pytest.approx(max(p) / sum(p), abs=1e-4)
        else:
            assert got[i].lang_pred == "und"
        assert got[i].held_out == (fold(i, 4) == 2)


def test_one_row_for_an_id_and_a_bound_in_bytes(spark):
    """An id on a hundred thousand rows comes once; long texts stop at the bound, and the same ones on any run."""
    hot = spark.range(100_000).select(F.lit("hot").alias("key"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"), F.lit(1).alias("y"))
    rng = np.random.default_rng(0)
    long = spark.createDataFrame([(f"k{i}", " ".join(f"w{x}" for x in rng.integers(0, 10**6, 20_000)), i % 2) for i in range(12)], "key string, text string, y int")
    rows = hot.union(long)
    found, _, y = learn.collect(rows.repartition(7), "y", T.IntegerType(), toxicity.terms)
    assert len(found) == len(y) == 13
    size = max(len(f) for f in found) * 4
    some = [learn.collect(rows.repartition(n), "y", T.IntegerType(), toxicity.terms, most=5 * size)[0] for n in (1, 5)]
    assert 3 <= len(some[0]) <= 6 and sum(len(f) for f in some[0]) * 4 <= 5 * size
    assert len(some[0]) == len(some[1]) and all(np.array_equal(a, b) for a, b in zip(*some))

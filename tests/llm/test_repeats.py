import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auralake.llm import repeats
from auralake.llm.anchors import _BASES, PRIMES, Checks, Sums, anchors
from auralake.llm.bwt import repeated


def brute(rows, least=100):
    """doc_id to (bytes, removed, spans, hash) of documents told apart by id, in id order (null first)."""
    seen, out = set(), {}
    for i, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            if w in seen:
                gone[s : s + least] = b"\1" * least
            seen.add(w)
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows, schema="doc_id long, text string", **how):
    df = spark.createDataFrame([(i, b.decode() if b is not None else None) for i, b in rows], schema).withColumn("n_bytes", F.lit("x")).repartition(3)
    return {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df, **how).collect()}


def test_expansion_equals_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(120):
        n, least = int(rng.integers(2, 300)), int(rng.integers(1, 13))
        x = rng.integers(1, 4, n).astype(np.uint16)
        if trial % 2:
            x = np.concatenate([x, [0], x[n // 3 :], [0], x[: n // 2], [0]]).astype(np.uint16)
        x = np.append(x, 0).astype(np.uint16)
        at, group = repeated(x, least)
        got = {}
        for a, g in zip(at.tolist(), group.tolist(), strict=True):
            got.setdefault(g, []).append(a)
        want = {}
        for i in range(len(x) - least + 1):
            w = tuple(x[i : i + least].tolist())
            if 0 not in w:
                want.setdefault(w, []).append(i)
        want = sorted(v for v in want.values() if len(v) > 1)
        valid = {i for v in want for i in v}
        assert sorted(sorted(v) for v in got.values() if v[0] in valid) == want


def test_every_window_has_one_anchor_by_its_bytes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        docs = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 120)).astype(np.uint8)) for _ in range(5)]
        data, offs = np.frombuffer(b"".join(docs), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        of = {}
        for p, h, lo, hi in zip(*anchors(Sums(data), offs, 20, 6), strict=True):
            for s in range(lo, hi + 1):
                assert s not in of
                of[s] = (int(p) - s, int(h))
        assert set(of) == {s for k in range(5) for s in range(offs[k], offs[k + 1] - 19)}
        by = {}
        for s, v in of.items():
            by.setdefault(bytes(data[s : s + 20]), set()).add(v)
        assert all(len(v) == 1 for v in by.values())


def test_checks_tell_apart_what_the_sums_do_not():
    bits = np.array([bin(i).count("1") % 2 for i in range(1024)], np.uint8)
    x, y = bits + 97, 98 - bits  # equal modulo 2**64 whatever the base
    data, at = np.concatenate([x, y, x]), np.array([0, 1024, 2048])
    assert len(set(Sums(data).slices(at, at + 1024, at * 0).tolist())) == 1
    a, b, c = Checks(data).slices(at, at + 1024).tolist()
    assert a == c != b
    for prime, shift in zip(PRIMES, (31, 0), strict=True):
        base = _BASES[PRIMES.index(prime)]
        want = sum((int(v) + 1) * pow(base, i, prime) for i, v in enumerate(y)) % prime
        assert b >> shift & (1 << 31) - 1 == want


@pytest.mark.parametrize("core,hot", [(512, 1024), (3, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, core, hot):
    monkeypatch.setattr(repeats, "CORE", core)  # 3: the way of crowded cores
    monkeypatch.setattr(repeats, "HOT", hot)  # 2: the way of crowded blocks
    rng = np.random.default_rng(7)
    words = ["alpha", "be", "gamma", "the", "öl", "x1", "zeta,", "\n"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.integers(0, 50)) for _ in range(n))
    shared, rows = text(40), []
    for i in range(60):
        t = text(int(rng.integers(0, 120)))
        if i % 3 == 0:
            t = text(8) + shared + text(7)
        if i % 7 == 0:
            t = t + " " + t
        if i % 10 == 9:
            t = rows[-1][1].decode()
        if i % 11 == 5:
            t = "ab" * int(rng.integers(40, 90))
        rows.append((i - 20, t.encode()))
    assert run(spark, rows) == brute(rows)


def test_pieces_cover_all_windows_once():
    text = bytes(range(97, 122)) * 2000
    pieces = list(repeats._pieces(pa.array([b"short".decode(), text.decode()]), 100, 5000))
    assert len(pieces) > 9 and [p[1] for p in pieces if p[0]] == list(range(0, len(text) - 99, 5000))
    assert all(bytes(d) == text[a : a + 5099] for i, a, d, _ in pieces if i)


def test_cases(spark):
    rng = np.random.default_rng(2)
    long = bytes(rng.integers(97, 123, 30_000).astype(np.uint8))
    rows = [(None, long[:150]), (1, b""), (2, b"a" * 99), (3, b"a" * 100), (4, b"a" * 300), (5, long), (6, b"q" + long[7:]), (7, long[100:199]), (8, long[100:200]), (9, long[20_000:] + long[:20_000])]
    assert run(spark, rows) == run(spark, rows, size=5000) == brute(rows)  # long texts are read in pieces
    ends = spark.createDataFrame([(None, long[:300].decode()), (-(2**63), long[:300].decode()), (2**63 - 1, long[:300].decode())], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.remove_repeats(ends).collect()) == [0, 300, 300]
    assert run(spark, [*rows, (10, None)])[10] == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    df = spark.createDataFrame([(1, long.decode()), (1, long.decode()), (2, long[:500].decode())], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in repeats.remove_repeats(df).collect())
    assert got == [(1, 30_000, 0), (1, 30_000, 0), (2, 500, 500)]  # a repeated row is the same document
    df = spark.createDataFrame([(1, long[:400].decode()), (1, ("z" + long[:400].decode()))], "doc_id long, text string")
    assert sorted(r.n_removed for r in repeats.remove_repeats(df).collect()) == [0, 400]  # texts that share an id are two
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text.encode()) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in repeats.op5_repeats(spark, "/root/testdata/sf0.001").collect()} == brute(rows)


def test_a_core_is_one_symbol_of_the_expansion(monkeypatch):
    seen = []
    monkeypatch.setattr(repeats, "repeated", lambda x, least: seen.append(len(x)) or repeated(x, least))
    monkeypatch.setattr(repeats, "EXPAND_BYTES", 5000)
    rng = np.random.default_rng(3)
    random = lambda n: bytes(rng.integers(97, 100, n).astype(np.uint8))
    rows, cores = [], [random(85) for _ in range(30)]
    for k in range(20):  # of two cores that share a hash, each is met in its own bytes
        for i in range(12):
            left, right = int(rng.integers(0, 16)), int(rng.integers(0, 16))
            ends = (b"aab" * 5, b"bba" * 5) if i % 2 else (random(15), random(15))
            row = ends[0][15 - left :] + cores[k + 10 * (i % 3 == 0)] + ends[1][:right]
            if len(row) >= 100:
                rows.append((k, 50 - i, 0, 1000 * k, left, row))
    names = ["k", "d", "t", "lo", "core", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 7], strict=True), kinds, strict=True)], names=names) for i in range(0, len(rows), 7)]
    got = {(d, w) for b in repeats._later(100)(iter(batches)) for d, s, e in zip(*(b.column(c).to_pylist() for c in ("d", "s", "e")), strict=True) for w in range(s, e - 99)}
    first, want = {}, set()
    for k, d, _, lo, _, row in sorted(rows, key=lambda r: (r[0], r[1])):
        for s in range(len(row) - 99):
            if first.setdefault((k, row[s : s + 100]), d) != d:
                want.add((d, lo + s))
    assert got == want and len(want) > 50
    assert len(seen) > 2 and 3 * sum(seen) < sum(len(r[5]) for r in rows)


def test_expansion_of_many_symbols():
    x = np.append(np.tile(np.arange(1, 70_000), 2), 0)
    at, group = repeated(x, 16)
    inside = at + 16 < len(x)
    assert sorted(at[inside & (at < 69_999)].tolist()) == [*range(69_984)] and len(np.unique(group[at < 69_984])) == 69_984

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auralake.llm import token_counts as tc
from auralake.llm import top_k as tk
from auralake.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tc.VOCABULARY))


def test_known_code_points_count_as_in_the_library(library):
    counter = tc.Counter(public_tokenizers.path(tc.VOCABULARY), tc.whole_tokens(library))
    for c in map(chr, range(tc.KNOWN)):
        for s in (c, f"a{c}b 1{c}{c}x", f"'{c}s {c}'t"):
            assert counter.count(s) == len(library.encode(s, add_special_tokens=False).ids), repr(s)


@pytest.mark.parametrize("s", ["x<|endoftext|>y", "ΣΑΣ ß €5 …", "é́", "İstanbul", "don't WE'LL i'd''s", "日本語 한국어 😀", "a\x1cb \x85c\xa0d", "a" * 20_000, "<|startoftext", "ﬁ Ⅷ ½"])
def test_odd_texts(library, s):
    counter = tc.Counter(public_tokenizers.path(tc.VOCABULARY), tc.whole_tokens(library))
    assert counter.count(s) == len(library.encode(s, add_special_tokens=False).ids)


def test_whole_tokens_are_one_token(library):
    whole = tc.whole_tokens(library)
    assert len(whole) > 30_000
    for w in sorted(whole)[::500]:
        assert len(library.encode(w, add_special_tokens=False).ids) == 1


def test_memo_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tc, "MEMO", 10)
    counts = tc.Counts(frozenset(["a"]), library)
    for i in range(50):
        assert counts[f"qx{i}z"] == len(library.encode(f"qx{i}z", add_special_tokens=False).ids)
    assert len(counts) <= 12


def test_counts_of_the_table(spark, library):
    got = {r.doc_id: r for r in tc.op2_token_counts(spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 2048)


def test_count_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "hello", 5), (2, "hello", 5), (2, "hello", 5)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens) for r in tc.count_tokens(docs).collect())
    assert got == [(0, 5, 1), (1, 0, 0), (1, 0, 0), (2, 5, 1), (2, 5, 1)]
    assert tc.count_tokens(docs.limit(0)).count() == 0


def brute(rows, k, every):
    fit = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in fit:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fit if i != q and len(b) == len(a))
            out += [(q, r + 1, i, max(min(-n, 2**63 - 1), -(2**63))) for r, (n, i) in enumerate(s[:k])]
    return sorted(out)


def test_top_k_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 4]) for i in range(300)]
    rows += [(300, None), (350, [float("nan")] * 8), (400, [1.0] * 7 + [None]), (450, [float("inf")] * 8), (500, []), (None, [0.5] * 8), (50, [0.25] * 8), (550, [1.0, 2.0]), (600, [2.0**40] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(5)
    got = sorted(tuple(r) for r in tk.top_k(df, df.where("vec_id % 50 = 0")).collect())
    assert got == brute(rows, 5, 50) and sum(g[0] == 50 for g in got) == 10  # two rows of one id are two queries
    assert tk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in tk.top_k(df, df.where("vec_id = 0")).collect()) == [(0, 1, 1, 128 * 256), (0, 2, 2, 0)]


def test_top_k_equals_its_sql(same):
    same(tk.op10_top_k, tk.ORACLES["op10_top_k"])

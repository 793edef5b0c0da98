import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auralake.llm import divergence as dv

SF = "/root/testdata/sf0.001"


def brute(rows, least, most):
    """rows: (text, lang, source)."""
    own, of_lang, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        own[lang, source].update(found)
        of_lang[lang].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares(of_lang[lang])
        p = {s: shares(own[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, found, cap in (("pair", pairs, None), ("term", terms, most)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:cap]
                out += [(lang, s, part, item, value, r + 1) for r, (item, value) in enumerate(ordered)]
    return sorted(out)


ROWS = [
    ("The cat THE Cat", "en", "a"), ("the dog", "en", "a"), ("the cat; dog's", "en", "b"), ("Straße straße STRASSE ÀÉ àé", "de", "a"), ("Straße straße", "de", None), (None, "de", "c"), ("", "en", "c"),
    ("123 _ []", "en", "d"), ("rare words only", "fr", "a"), ("others here", "fr", "b"), ("nolang x x", None, "a"), ("nolang y", None, None), ("nolang", "", "\U0001f600"), ("nolang nolang", "", "￮"),
    ("lone", "es", "a"), ("tie1 tie", "en", "e"), ("the " * 20_000, "en", "e"), ("the cat", "en", "a"), ("the cat", "en", "a"), ("日本 語 日本", "ja", "x"), ("日本", "ja", "y"),
]


@pytest.mark.parametrize("least, most", [(2, 50), (1, 2), (3, 1)])
def test_equals_brute_force(spark, least, most):
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string").withColumns({"term": F.lit("x"), "n": F.lit(1), "item": F.lit(2), "p": F.lit(3), "terms": F.lit(4)}).repartition(4)
    assert sorted(tuple(r) for r in dv.audit(docs, least=least, most=most).collect()) == brute(ROWS, least, most)


def test_equals_brute_force_on_the_table(spark):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in dv.op13_divergence(spark, SF).collect()) == brute(rows, dv.LEAST_DOCS, dv.MOST_TERMS)


def test_equals_its_sql(same):
    same(dv.op13_divergence, dv.ORACLES["op13_divergence"])


def test_empty_table_and_sources_without_terms(spark):
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string")
    assert dv.audit(docs.limit(0)).count() == 0
    bare = spark.createDataFrame([(None, None, None), ("", "", "b")], "text string, lang string, source string")
    assert sorted(tuple(r) for r in dv.audit(bare).collect()) == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_shares_are_exact_beyond_long(spark):
    rows = [(n, total, kinds) for n in (0, 1, 10**12 + 7, 10**16) for total in (10**16 + 3, 10**17) for kinds in (1, 10**9 + 7)]
    got = spark.createDataFrame(rows, "n long, total long, kinds long").select("n", "total", "kinds", dv.share(F.col("n"), F.col("total"), F.col("kinds")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 5) // (r.total + 5 * r.kinds) for r in got)

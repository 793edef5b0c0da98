import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auralake.llm import exact_dups as ed

SF = "/root/testdata/sf0.001"
HASHES = {"wide": F.xxhash64, "narrow": lambda c: F.pmod(F.xxhash64(c), F.lit(3)), "none": lambda c: F.octet_length(c).cast("long") * 0}


def brute(rows):
    groups = defaultdict(list)
    for id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(id)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=str)


ROWS = [
    (1, None), (2, ""), (3, " \t\n"), (4, " "), (None, "a  b"), (5, "a b"), (5, "a\x0b\x0cb"), (6, "a\x1cb"), (7, "a\xa0b"), (None, "lone"), (None, "lone"), (8, "lone "),
    (-(2**63), "x" * 4), (2**63 - 1, "x" * 4), (9, "x" * 5), (10, "x" * 8), (11, "x" * 9), (12, "x" * 1000), (13, "x" * 1000), (14, "x" * 999 + "y"), (15, "é😀" * 333), (16, "é😀" * 333), (17, "é😀" * 333 + "e"),
    (18, "abcd" * 7 + "efgh"), (19, "abcd" * 8), (20, "efgh" + "abcd" * 7), (20, "efgh" + "abcd" * 7),
]


@pytest.mark.parametrize("name", sorted(HASHES))
def test_equals_brute_force_whatever_the_hash(spark, name):
    """Hashes only route: with three values of the hash, or one, the result is the same."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    docs = docs.withColumns({"row": F.lit(1), "h": F.lit("x"), "block": F.lit(2), "name": F.lit(3), "n": F.lit(4), "size": F.lit(5)})
    got = ed.exact_dups(docs, size=4, hashed=HASHES[name]).drop("level", "name").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)


def test_one_name_for_one_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for size in (1, 3, 4096):
        got = ed.exact_dups(docs, size=size).select("text_sha256", "level", "name").distinct().collect()
        assert len({r.text_sha256 for r in got}) == len({(r.level, r.name) for r in got}) == len(got)


def test_names_are_the_same_on_any_run(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    runs = [sorted(tuple(r) for r in ed.exact_dups(docs.repartition(n), size=4).select("text_sha256", "level", "name").collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_equals_its_sql(same):
    same(ed.op11_exact_dups, ed.ORACLES["op11_exact_dups"])


def test_equals_brute_force_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in ed.op11_exact_dups(spark, SF).collect()), key=str) == brute(docs)


def test_empty_table_and_no_python(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert ed.exact_dups(docs.limit(0)).count() == 0
    plan = ed.exact_dups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

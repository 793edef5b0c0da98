import re

import pytest
from pyspark.sql import functions as F

from auralake.llm import source_mix as sm

SF = "/root/testdata/sf0.001"


def targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Rounds of resharing, as the contract has it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, dict(w)
    budget = sum(sizes.values())
    while left:
        rest, total = budget - sum(fixed.values()), sum(left.values())
        over = [s for s in left if rest * left[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: rest * left[s] / total for s in left}
        for s in over:
            fixed[s] = 3 * sizes[s]
            del left[s]
    return fixed


def test_equals_its_sql(same):
    same(sm.op6_source_mix, sm.ORACLES["op6_source_mix"])


@pytest.mark.parametrize("rows", [[("a", 100), ("b", 1), ("c", 50), (None, 7), ("d", 0), ("\U0001f600", 9), ("�", 4)], [("a", 10)], [("z", 0), ("y", 0)], [("b", 1), ("a", 1000)]])
def test_targets_equal_resharing_by_rounds(spark, rows):
    df = spark.createDataFrame(rows, "source string, size long")
    got = {r.source: r.target for r in sm.source_targets(df).collect()}
    want = targets({s: n for s, n in rows})
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-4 for s in want)


def test_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    got = sm.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert {r.doc_id: r.size for r in got} == sizes
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].source_size == sum(r.size for r in own)
        assert len({r.taken // r.size for r in own if r.size}) <= 2  # complete epochs, then a part of one more
    again = sm.mix_sources(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_quality_comes_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 10).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), (1 + F.col("id") % 8 / 2).alias("weight"))
    r = sm.mix_sources(docs, weight=F.col("weight")).join(docs.select("doc_id", "weight"), "doc_id").where("source_size > 20000").groupBy((F.col("weight") > 3).alias("high")).agg(F.avg("taken").alias("t")).collect()
    mean = {x.high: x.t for x in r}
    assert mean[True] > mean[False]


@pytest.mark.parametrize("least", [0.05, 0.25, 1.0])
def test_buckets_are_about_equally_full(spark, monkeypatch, least):
    """The largest holds less than 4 times the mean for weights of 0.05 to 1."""
    monkeypatch.setattr(sm, "cut", lambda df: df)
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("a").alias("source"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(least).alias("weight"))
    plan = sm.mix_sources(docs, weight=F.col("weight"))
    u = sm.hashed_uniform(F.col("doc_id"), "mix")
    keys = docs.select("weight", (-F.log(u) / F.col("weight")).alias("key"))
    classes = F.array(*(F.struct(F.lit(n * a).alias("n"), F.lit(w).alias("w")) for a, w in ((1 / 3, 1.0), (2 / 3, least))))
    sizes = [r["count"] for r in keys.groupBy(sm.bucket_of(F.col("key"), classes)).count().collect()]
    assert max(sizes) < 4 * n / len(sizes) and len(sizes) > 0.8 * n / sm.BUCKET_ROWS and plan.count() == n


def test_cases(spark):
    rows = [(1, None, None, 0), (2, "", "a", 0), (None, "x y", "a", 0), (3, "x y", "a", 0), (3, "x y", "a", 0), (4, "x " * 50_000, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rows int").withColumn("key", F.lit(1)).withColumn("target", F.lit(2))
    got = sm.mix_sources(docs).collect()
    assert len(got) == 6 and sum(r.taken for r in got) <= 50_006 and all(r.taken <= 3 * r.size for r in got)
    assert sm.mix_sources(docs.limit(0)).count() == 0

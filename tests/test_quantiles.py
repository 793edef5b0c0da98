import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import metrics
from auralake.operators import quantiles as qs

NAN, INF = float("nan"), float("inf")
P = [0.0, 0.25, 0.5, 0.95, 1.0]


def frame(spark, values, parts=4):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(parts)


def brute(values):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    out = []
    for p in P:
        place = p * (len(v) - 1)
        a, b = v[math.floor(place)], v[math.ceil(place)]
        out.append(a if a == b or math.floor(place) == math.ceil(place) else (math.ceil(place) - place) * a + (place - math.floor(place)) * b)
    return len(v), out


CASES = {
    "one": [3.5], "two": [1.0, 2.0], "equal": [2.0] * 50, "signs": [-1.5, 0.0, -0.0, 1.5, -1e300, 1e300, 5e-324, -5e-324], "nulls": [None, 1.0, None, 3.0],
    "close": [1 + i * 2.0**-52 for i in range(30)], "wide": [10.0**i for i in range(-300, 300, 7)], "nan": [1.0, NAN, 2.0, NAN], "inf": [-INF, 1.0, 2.0, INF, INF],
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("few", [1, 4096])
def test_cases(spark, monkeypatch, name, few):
    monkeypatch.setattr(qs, "FEW", few)
    monkeypatch.setattr(qs, "BINS", 4 if few == 1 else 4096)
    got = qs.exact_quantiles(frame(spark, CASES[name]), "v", P).collect()
    n, want = brute(CASES[name])
    assert len(got) == 1 and got[0].n == n
    for i, w in enumerate(want):
        g = got[0][f"q{i}"]
        assert (math.isnan(g) and math.isnan(w)) or g == pytest.approx(w, rel=1e-15, abs=0), (name, P[i])


def test_no_values(spark):
    assert [tuple(r) for r in qs.exact_quantiles(frame(spark, [None, None]), "v", [0.5]).collect()] == [(0, None)]
    grouped = frame(spark, [None]).withColumn("k", F.lit(1))
    assert qs.exact_quantiles(grouped, "v", [0.5], ["k"]).count() == 0


def test_groups_with_a_null_key_and_a_hot_one(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 1001 == 0, None).otherwise((F.col("id") % 97).cast("string")).alias("k"), (F.rand(5) * 1000 - 300).alias("v"))
    rows = spark.createDataFrame(rows.toPandas()).repartition(4)
    got = {r.k: r for r in qs.exact_quantiles(rows, "v", [0.5, 0.95], ["k"]).collect()}
    want = {r.k: r for r in rows.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.95).alias("b")).collect()}
    assert got.keys() == want.keys() and len(got) > 90
    for k, r in want.items():
        assert got[k].n == r.n and got[k].q0 == pytest.approx(r.a, rel=1e-12) and got[k].q1 == pytest.approx(r.b, rel=1e-12)


def test_ten_million_distinct_values_without_a_buffer_of_them(spark):
    n = 10_000_000
    # A permutation of 0..n-1: multiplication by a number prime to n.
    rows = spark.range(0, n, 1, 8).select(((F.col("id") * 7_919_999) % n).cast("double").alias("v"))
    df = qs.exact_quantiles(rows, "v", [0.5, 0.95])
    r = df.first()
    assert (r.n, r.q0) == (n, (n - 1) / 2) and r.q1 == pytest.approx(0.95 * (n - 1), rel=1e-15)
    plan = metrics.summary(rows.select(F.lit(200).alias("status"), F.col("v").alias("response_time")))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_crowded_intervals(spark):
    rows = spark.range(5000).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.when(F.col("id") % 2 == 0, 30).otherwise(F.col("id")))).alias("ts"), (F.col("id") * 37 % 1009).cast("double").alias("response_time"), F.lit(200).alias("status"), F.col("id").alias("request_id"))
    a, b = (metrics.time_series(rows, "1 minute", crowded=c).orderBy("timestamp").collect() for c in (1000, 10**9))
    assert a == b and max(r.attempts_per_s for r in a) > 2000


def test_sketch_keeps_its_error_when_merged(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 3, 4000), -rng.lognormal(1, 2, 3000), np.zeros(100)])
    parts = [frame(spark, p, 2).withColumn("k", F.lit(i % 2)) for i, p in enumerate(np.array_split(values, 3))]
    merged = qs.merge(*(qs.sketch(p, "v", ["k"]) for p in parts))
    counts = merged.groupBy("bucket").agg(F.sum("n").alias("n"))
    got = {r.probability: r.value for r in qs.estimate(counts, P).collect()}
    ordered = np.sort(values)
    for p in P:
        true = ordered[math.floor(p * (len(values) - 1))]
        assert abs(got[p] - true) <= qs.ERROR * abs(true) + 1e-12, p
    assert {(r.k, r.probability) for r in qs.estimate(merged, [0.5], ["k"]).collect()} == {(0, 0.5), (1, 0.5)}


def test_sketch_of_a_stream(spark, tmp_path):
    stamp = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))
    rows = spark.range(3000).select(stamp.alias("ts"), (F.col("id") % 500 + 1).cast("double").alias("v"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = qs.sketch(stream, "v", [F.window("ts", "10 minutes")["start"].alias("at")])
    counts.writeStream.format("memory").queryName("sketched").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = qs.estimate(spark.table("sketched"), [0.5], ["at"]).collect()
    want = {r.at: r.m for r in rows.groupBy(F.window("ts", "10 minutes")["start"].alias("at")).agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert len(got) == len(want) == 5 and all(abs(r.value - want[r.at]) <= 1 + qs.ERROR * want[r.at] for r in got)

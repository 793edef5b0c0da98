"""Operators that no query reaches."""

import numpy as np
from pyspark.sql import functions as F

from auralake.functions import tokens
from auralake.operators import metrics
from auralake.streaming import streams


def test_console(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"text": "hello console", "speaker": "x"}\n')
    query = streams.console(streams.requests(spark, str(tmp_path / "in")))
    query.processAllAvailable()
    progress = query.recentProgress
    query.stop()
    assert sum(p.numInputRows for p in progress) == 1 and "ConsoleTable" in progress[0].sink.description


def test_join_books(spark):
    df = spark.createDataFrame([([[1, 2], [3]], [[4], [5, 6]]), ([[], []], [[7], [8]])], "a array<array<int>>, b array<array<int>>")
    assert [r.j for r in df.select(tokens.join_books(F.col("a"), F.col("b")).alias("j")).collect()] == [[[1, 2, 4], [3, 5, 6]], [[7], [8]]]


def test_throughput_of_no_time(spark):
    df = spark.createDataFrame([(10, 5, 0.5, 1.5), (10, 5, 1.0, 1.0), (10, 5, 0.0, 0.0)], "input_tokens long, output_tokens long, time_to_first_token double, time_to_last_token double")
    got = [(r.total_tokens, r.toks_per_s, r.gen_toks_per_s) for r in metrics.throughput(df).collect()]
    assert got == [(15, 10.0, 5.0), (15, 15.0, None), (15, None, None)]


def test_summary_of_no_requests(spark):
    empty = spark.createDataFrame([], "status int, response_time double")
    assert tuple(metrics.summary(empty).first()) == (0, 0, 0, None, None, None, None)
    failed = spark.createDataFrame([(500, 1.0), (None, 2.0)], "status int, response_time double")
    assert tuple(metrics.summary(failed).first()) == (2, 0, 2, None, None, None, None)


def test_rates(spark):
    rows = spark.range(0, 3601, 90).select(F.col("id"), metrics.rate_at(F.col("id"), 0.5, 5.0, 0.5, 360).alias("q"))
    assert all(abs(r.q - min(0.5 + r.id // 360 * 0.5, 5.0)) < 1e-12 for r in rows.collect())
    whole = spark.range(1).select(F.explode(metrics.rate_schedule(0.5, 5.0, 0.5, 3600, 360)).alias("s")).select("s.*").collect()
    assert len(whole) == 3600 and np.allclose([r.qps * r.delay for r in whole], 1)


def test_having_reaches_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df = metrics.having(events, "event_type", ["purchase", "error"], ["value"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(value)" in plan.split("PushedFilters")[1] and "In(event_type" in plan.split("PushedFilters")[1]
    assert {r[0] for r in df.select("event_type").distinct().collect()} == {"purchase", "error"}
    assert metrics.having(events, "event_type", ["none"]).count() == 0

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auralake.functions import logits


def rows(spark, n, values):
    return spark.range(n).select("id", F.array(*(F.lit(v) for v in values)).alias("l"))


@pytest.mark.parametrize("temperature", [1.0, 0.5])
def test_frequencies_are_those_of_softmax(spark, temperature):
    values, n = [0.0, 1.0, 2.0, -1.0, float("-inf")], 20_000
    df = rows(spark, n, values)
    got = Counter(r[0] for r in df.select(logits.sample(F.col("l"), F.col("id"), temperature=temperature, seed=3)).collect())
    p = df.select(logits.softmax(F.col("l"), temperature)).first()[0]
    for i, share in enumerate(p):
        assert abs(got[i] - n * share) <= 4.5 * math.sqrt(n * share * (1 - share)) + 1e-9


def test_draws_without_replacement(spark):
    values, n = [0.0, 1.0, 0.5], 12_000
    pairs = Counter(tuple(r[0]) for r in rows(spark, n, values).select(logits.gumbel_top(F.col("l"), F.col("id"), 2)).collect())
    e = [math.exp(v) for v in values]
    for (i, j), count in pairs.items():
        share = e[i] / sum(e) * e[j] / (sum(e) - e[i])
        assert i != j and abs(count - n * share) <= 4.5 * math.sqrt(n * share * (1 - share))


def test_reruns_agree_and_seeds_do_not(spark):
    df = rows(spark, 500, [0.1 * i for i in range(30)])
    draw = lambda d, seed: {r.id: tuple(r.s) for r in d.select("id", logits.gumbel_top(F.col("l"), F.col("id"), 3, seed=seed).alias("s")).collect()}
    assert draw(df, 1) == draw(df.repartition(7), 1) != draw(df, 2)
    # The same seed at another step of the same row draws anew.
    step = {r.id: tuple(r.s) for r in df.select("id", logits.gumbel_top(F.col("l"), F.concat_ws("/", F.col("id"), F.lit(1)), 3, seed=1).alias("s")).collect()}
    assert step != draw(df, 1)


def test_cases(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [float("-inf"), None, float("nan")]), (4, [float("-inf"), 2.0]), (5, [3.0, 3.0, 1.0])], "id long, l array<double>")
    got = {r.id: (r.s, r.g, r.one) for r in df.select("id", logits.gumbel_top(F.col("l"), F.col("id"), 5).alias("s"), logits.gumbel_top(F.col("l"), F.col("id"), 2, 0).alias("g"), logits.sample(F.col("l"), F.col("id"), top=1).alias("one")).collect()}
    assert got[1] == ([], [], None) and got[2] == (None, None, None) and got[3] == ([], [], None) and got[4] == ([1], [1], 1)
    assert sorted(got[5][0]) == [0, 1, 2] and got[5][1] == [0, 1] and got[5][2] in (0, 1)

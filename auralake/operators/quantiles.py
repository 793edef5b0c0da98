"""Quantiles of any number of values: exact ones by narrowing ranges, and a mergeable sketch.

Both rest on one histogram. A finite value lies in bucket ceil(log(|v|) / log(gamma)), on the side of its
sign; the logarithm and the ceiling never fall as v grows, so buckets are in the order of the values,
and a table of counts by bucket is a few thousand rows however many values there are.

exact_quantiles: the bucket that a rank is in is cut into `BINS` equal steps, the step that it is in again,
until few enough values are left to be sorted or all of them are equal. A bucket holds 2**46 doubles at
most, so this takes five rounds at most, whatever the values are. Each round is one pass and one grouping,
combined on the map side; no buffer holds a group's values, hot groups included.

sketch, merge, estimate: the counts themselves. Sketches are added by adding counts, in batch or in a
stream, and an estimate is off by at most `error` of the true value of its rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.scratch import written

#: Relative error of a bucket's middle.
ERROR = 0.01
#: Steps that a range is cut into, and values that are sorted at once.
BINS, FEW = 4096, 4096
#: Buckets of positive values are above 0 and at most twice this, those of negative ones below; -inf, inf and NaN lie beyond.
_SPAN = 1 << 20
_RANGE = ("lo", "hi", "below", "inside")


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float = ERROR) -> Column:
    """The bucket of a double; never falls as the value grows, NaN above all others."""
    v = value.cast("double")
    place = F.ceil(F.log(F.abs(v)) / F.lit(math.log(_gamma(error)))).cast("int") + F.lit(_SPAN)
    far = F.when(F.isnan(v), 4 * _SPAN).when(v == float("inf"), 3 * _SPAN).when(v == float("-inf"), -3 * _SPAN)
    return F.coalesce(far, F.when(v > 0, place).when(v < 0, -place).when(v == 0, 0)).cast("int")


def middle_of(bucket: Column, error: float = ERROR) -> Column:
    """The value that is within `error` of all values of a bucket, relative to them."""
    gamma = _gamma(error)
    middle = F.exp((F.abs(bucket) - F.lit(_SPAN)) * F.lit(math.log(gamma))) * F.lit(2 / (gamma + 1))
    beyond = F.when(bucket == 4 * _SPAN, float("nan")).when(bucket == 3 * _SPAN, float("inf")).when(bucket == -3 * _SPAN, float("-inf"))
    return F.coalesce(beyond, F.when(bucket == 0, 0.0).otherwise(F.signum(bucket.cast("double")) * middle))


def sketch(rows: DataFrame, value: str, by: Sequence[str | Column] = (), error: float = ERROR) -> DataFrame:
    """by, bucket and n: how many values each bucket has; nulls are left out. One row a bucket, of a batch or a stream."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, bucket_of(F.col(value), error).alias("bucket")).agg(F.count("*").alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """One sketch of several with the same keys and error, in any order and grouping."""
    whole = sketches[0]
    for s in sketches[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*[c for c in whole.columns if c != "n"]).agg(F.sum("n").alias("n"))


def _running(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """counts (by, bucket, n) with the number below each bucket and in all; a group has few thousand buckets at most."""
    keys = [*by] or [F.lit(0)]  # a sketch without keys is few rows as a whole
    ordered = Window.partitionBy(*keys).orderBy("bucket")
    return counts.withColumns({"below": F.sum("n").over(ordered) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(*keys))})


def estimate(counts: DataFrame, probabilities: Sequence[float], by: Sequence[str] = (), error: float = ERROR) -> DataFrame:
    """by, probability and value: that of rank floor(p * (n - 1)), to within `error` of it."""
    asked = F.explode(F.array(*(F.lit(float(p)) for p in probabilities)))
    ranks = _running(counts, by).withColumn("probability", asked).withColumn("rank", F.floor(F.col("probability") * (F.col("total") - 1)))
    met = ranks.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
    return met.select(*by, "probability", middle_of(F.col("bucket"), error).alias("value"))


def _joined(rows: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each value with each range of its group that it lies in; ranges are few for a group, and NaN is a value like others."""
    held = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    renamed = ranges.withColumnsRenamed({c: f"__{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return rows.join(renamed, [*same, held]).drop(*(f"__{c}" for c in by))


def _narrowed(counted: DataFrame, by: Sequence[str], start: Column) -> DataFrame:
    """Of bins (by, rank, bin, lo, hi, inside) the one that each rank is in."""
    ordered = Window.partitionBy(*by, "rank").orderBy("bin")
    placed = counted.withColumn("below", start + F.sum("inside").over(ordered) - F.col("inside"))
    return placed.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside"))).select(*by, "rank", *_RANGE)


def _of_all(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """exact_quantiles without keys: counts of bins are few enough to be read on the driver, and ranges go back as literals, which the scan filters by."""
    found = sorted(values.groupBy(bucket_of(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r.bucket)
    n = sum(r.n for r in found)
    places = [float(p) * (n - 1) for p in probabilities]
    ranks = sorted({f(x) for x in places for f in (math.floor, math.ceil)}) if n else []

    def holding(rank: int, bins: list[tuple[float, float, int]], below: int) -> tuple[float, float, int, int]:
        """lo, hi, the number below and the number inside of the bin (lo, hi, n) that a rank is in."""
        for lo, hi, inside in bins:
            if rank < below + inside:
                return lo, hi, below, inside
            below += inside
        raise AssertionError("a rank beyond all values")

    ranges = {k: holding(k, [(r.lo, r.hi, r.n) for r in found], 0) for k in ranks}
    within = lambda r: (F.col("v") >= F.lit(r[0])) & (F.col("v") <= F.lit(r[1]))
    while wide := {k: r for k, r in ranges.items() if r[0] < r[1] and r[3] > FEW}:
        steps = [F.when(within(r), F.struct(F.lit(k).alias("rank"), F.floor((F.col("v") - F.lit(r[0])) / F.lit(r[1] - r[0]) * BINS).cast("int").alias("bin"))) for k, r in wide.items()]
        cut = values.where(reduce(or_, map(within, wide.values()))).select("v", F.explode(F.array(*steps)).alias("x")).where("x IS NOT NULL")
        counted = cut.groupBy("x.rank", "x.bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()
        for k, r in wide.items():
            own = sorted((c.bin, c.lo, c.hi, c.n) for c in counted if c.rank == k)
            ranges[k] = holding(k, [c[1:] for c in own], r[2])
    left = {k: r for k, r in ranges.items() if r[0] < r[1]}
    some = sorted(r.v for r in values.where(reduce(or_, map(within, left.values()))).select("v").collect()) if left else []
    at = {k: r[0] for k, r in ranges.items()} | {k: [v for v in some if r[0] <= v <= r[1]][k - r[2]] for k, r in left.items()}

    def between(x: float) -> float | None:
        if not n:
            return None
        low, high = at[math.floor(x)], at[math.ceil(x)]
        same = low == high or math.floor(x) == math.ceil(x)
        return low if same else (math.ceil(x) - x) * low + (x - math.floor(x)) * high

    schema = "n long, " + ", ".join(f"q{i} double" for i in range(len(places)))
    return values.sparkSession.createDataFrame([(n, *map(between, places))], schema)


def exact_quantiles(rows: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, n (values that are not null) and q0, q1, ...: quantiles as `percentile` has them, between two ranks in proportion.

    Groups without values have no row; without keys there is always one, with nulls if there are no values. NaN
    counts as the largest value. Names of the keys must not begin with __.
    """
    values = rows.where(F.col(value).isNotNull()).select(*by, (F.col(value).cast("double") + F.lit(0.0)).alias("v"))
    if not by:
        return _of_all(values, probabilities)
    bins = values.groupBy(*by, bucket_of(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    bins = written(_running(bins, by))
    last = F.col("total") - 1
    ends = [f(F.lit(float(p)) * last) for p in probabilities for f in (F.floor, F.ceil)]
    asked = F.explode(F.array_distinct(F.array(*ends)))
    ranks = bins.withColumn("rank", asked).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
    ranges = written(ranks.select(*by, "rank", "lo", "hi", "below", F.col("n").alias("inside")))
    done, wide = [], (F.col("lo") < F.col("hi")) & (F.col("inside") > FEW)
    while not ranges.where(wide).isEmpty():
        done.append(ranges.where(~wide))
        step = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int")
        counted = _joined(values, ranges.where(wide), by).groupBy(*by, "rank", F.col("below").alias("start"), step.alias("bin"))
        counted = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("inside"))
        ranges = written(_narrowed(counted, by, F.col("start")))
    for part in done:
        ranges = ranges.union(part)
    equal = F.col("lo") == F.col("hi")
    # What is left of a range is FEW values at most.
    sorted_ = _joined(values, ranges.where(~equal), by).groupBy(*by, "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    picked = sorted_.select(*by, "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    picked = picked.union(ranges.where(equal).select(*by, "rank", F.col("lo").alias("v")))
    found = picked.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    totals = bins.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))

    def between(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.try_element_at("at", F.floor(place)), F.try_element_at("at", F.ceil(place))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    other = found.withColumnsRenamed({c: f"__{c}" for c in by})
    whole = totals.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return whole.select(*by, "n", *(between(p).alias(f"q{i}") for i, p in enumerate(probabilities)))

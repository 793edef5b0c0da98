"""Request metrics: per-interval series, totals, and the scalars that feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.operators import numbering
from auralake.operators.quantiles import exact_quantiles
from auralake.scratch import written

OK = 200

#: Intervals of the spine that one row makes.
SPINE_ROWS = 4096
#: Requests of an interval above which its percentile is found by narrowing ranges, not in one buffer of its values.
CROWDED = 1 << 20


def succeeded(status: Column) -> Column:
    return F.when(status == OK, 1.0).otherwise(0.0)


def having(rows: DataFrame, column: str, values: list, present: list[str] = ()) -> DataFrame:
    """The rows whose column is one of values and whose `present` columns are neither null nor NaN; both reach the scan as filters."""
    found = rows.where(F.col(column).isin(*values))
    for c in present:
        found = found.where(F.col(c).isNotNull())
    return found.na.drop(subset=list(present)) if present else found


def series_aggregates(request: str = "request_id", seconds: str = "response_time", status: str = "status", approximate: bool = False, p95: Column | None = None) -> list[Column]:
    """What a bin reports. Failed requests have no id, so requests_per_s counts successes; attempts_per_s counts all."""
    if p95 is None:
        p95 = F.percentile_approx(seconds, 0.95, 10_000) if approximate else F.percentile(seconds, 0.95)
    return [
        F.count(request).alias("requests_per_s"),
        F.count("*").alias("attempts_per_s"),
        F.avg(seconds).alias("avg_response_time"),
        F.min(seconds).alias("min_response_time"),
        F.max(seconds).alias("max_response_time"),
        F.stddev_samp(seconds).alias("std_response_time"),
        p95.alias("p95_response_time"),
        (F.avg(succeeded(F.col(status))) * 100).alias("success_rate"),
    ]


def time_series(requests: DataFrame, every: str = "1 second", ts: str = "ts", fill: bool = True, crowded: int = CROWDED, **columns: str) -> DataFrame:
    """One row per interval from the first to the last request; intervals without requests have counts of 0.

    One shuffle by interval; the spine is generated from two bounds, in two steps so that no row holds all of
    it and many tasks take part, and joined to the few binned rows. Intervals of more than `crowded` requests, told
    by a count beforehand, have their percentile from `exact_quantiles`, so that no task holds all their values.
    """
    start, seconds = F.window(ts, every)["start"], columns.get("seconds", "response_time")
    full = requests.groupBy(start.alias("__full")).agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("__full")
    if full.isEmpty():
        bins = requests.groupBy(start.alias("timestamp")).agg(*series_aggregates(**columns))
    else:
        full = F.broadcast(written(full))  # 2**20 rows of the input for each
        marked = requests.withColumn("timestamp", start).join(full, F.col("timestamp") == F.col("__full"), "left")
        other = F.percentile(F.when(F.col("__full").isNull(), F.col(seconds)), 0.95)
        exact = exact_quantiles(marked.where("__full IS NOT NULL").select(F.col("__full"), F.col(seconds).alias("__v")).withColumnRenamed("__full", "full"), "__v", [0.95], ["full"])
        bins = marked.groupBy("timestamp").agg(*series_aggregates(p95=other, **columns)).join(exact, F.col("timestamp") == F.col("full"), "left")
        bins = bins.withColumn("p95_response_time", F.coalesce("p95_response_time", "q0")).drop("full", "n", "q0")
    if not fill:
        return bins
    bounds = bins.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).where("lo IS NOT NULL")
    step = lambda n: F.expr(f"(INTERVAL {every}) * {n}")
    starts = bounds.select("hi", F.explode(F.sequence("lo", "hi", step(SPINE_ROWS))).alias("start")).repartition("start")
    spine = starts.select(F.explode(F.sequence("start", F.least("hi", F.col("start") + step(SPINE_ROWS - 1)), step(1))).alias("timestamp"))
    return spine.join(bins, "timestamp", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("requests_per_s", "attempts_per_s")})


def summary(requests: DataFrame, seconds: str = "response_time", status: str = "status") -> DataFrame:
    """Totals over all requests, and response times over the successful ones; the median by narrowing ranges."""
    good = F.col(status) == OK
    of = F.when(good, F.col(seconds))
    median = exact_quantiles(requests.select(of.alias("v")), "v", [0.5]).select(F.col("q0").alias("median_response_time"))
    totals = requests.agg(
        F.count("*").alias("total"),
        F.count_if(good).alias("successes"),
        (F.count("*") - F.count_if(good)).alias("failures"),
        F.avg(of).alias("avg_response_time"),
        F.min(of).alias("min_response_time"),
        F.max(of).alias("max_response_time"),
    )
    return totals.crossJoin(F.broadcast(median))  # one row each


def generation_summary(requests: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Means over the requests that have metrics: the first of each list, and the end-to-end time of the generation."""
    m = requests.where(F.col(metrics).isNotNull()).select(f"{metrics}.*")
    return m.agg(
        F.avg(F.get("time_to_first_token", 0)).alias("avg_time_to_first_token"),
        F.avg(F.get("time_to_last_token", 0)).alias("avg_time_to_last_token"),
        F.avg("generate_end_to_end_time").alias("avg_end_to_end_time"),
    )


def relative_time(requests: DataFrame, ts: str = "ts") -> DataFrame:
    """relative_time: seconds since the first request. The bound is one row, so no window gathers all rows."""
    first = requests.agg(F.min(ts).alias("__first"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return requests.crossJoin(F.broadcast(first)).withColumn("relative_time", (micros(ts) - micros("__first")) / 1e6).drop("__first")


def rate_at(second: Column, least: float, most: float, step: float, every: int) -> Column:
    """Requests a second at a second of a load test whose rate rises by step."""
    return F.least(F.lit(least) + F.floor(second / every) * F.lit(step), F.lit(most))


def rate_schedule(least: float, most: float, step: float, seconds: int, every: int) -> Column:
    """The rate at each second of a load test: array of (second, qps, delay)."""
    at = F.sequence(F.lit(0), F.lit(seconds - 1))
    qps = lambda t: rate_at(t, least, most, step, every)
    return F.transform(at, lambda t: F.struct(t.alias("second"), qps(t).alias("qps"), (1 / qps(t)).alias("delay")))


def throughput(speeds: DataFrame) -> DataFrame:
    """total_tokens, toks_per_s and gen_toks_per_s of generation records."""
    from auralake.functions.signal import speed

    total = F.col("input_tokens") + F.col("output_tokens")
    return speeds.withColumns({"total_tokens": total, "toks_per_s": speed(total, F.col("time_to_last_token")), "gen_toks_per_s": speed(F.col("output_tokens"), F.col("time_to_last_token") - F.col("time_to_first_token"))})


def first_by(rows: DataFrame, order: list[str], n: int = 25) -> DataFrame:
    """The first n rows in an order that leaves no ties: a top-k plan, not a full sort."""
    return rows.orderBy(*order).limit(n)


def seeded_sample(rows: DataFrame, key: str, n: int = 1, seed: int = 1337) -> DataFrame:
    """n rows chosen by a hash of their key: the same ones on any run and in any order."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def pick(a: Column, key: Column, seed: int = 1337) -> Column:
    """One element of an array, chosen by a hash of the key; null for an empty array."""
    return F.when(F.size(a) > 0, F.get(a, F.pmod(F.xxhash64(key, F.lit(seed)), F.size(a)).cast("int")))


def batches(rows: DataFrame, order: str | list[str], n: int = 256, unique: bool = False) -> DataFrame:
    """batch and the rows in it as an array, exactly n at a time but for the last, in an order that may have gaps and ties."""
    return numbering.batches(rows, [order] if isinstance(order, str) else order, n, unique)


def dataset_totals(rows: DataFrame, books: str = "codes") -> DataFrame:
    """Samples, and frames over all samples (the length of a matrix's rows)."""
    return rows.agg(F.count("*").alias("samples"), F.sum(F.size(F.get(books, 0))).cast("long").alias("frames"))

"""Structured Streaming: requests and logs from folders, interval metrics with late data, appends, load."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auralake.operators.feedback import TABLE, append
from auralake.operators.metrics import series_aggregates
from auralake.sources.files import LOG_SCHEMA, REQUEST_SCHEMA


def requests(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def logs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(LOG_SCHEMA).json(folder)


def finished(outputs: DataFrame, flag: str = "finished") -> DataFrame:
    """The outputs that are complete, of a stream that repeats each as it grows."""
    return outputs.where(F.col(flag))


def time_series(stream: DataFrame, every: str = "1 second", late: str = "10 seconds", ts: str = "ts", approximate: bool = True, **columns: str) -> DataFrame:
    """The interval metrics; rows later than `late` behind the newest are left out in append and update mode.

    The exact percentile keeps every value of an open interval; the approximate one a bounded sketch.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, every)["start"].alias("timestamp"), F.window(ts, every).alias("__w")).agg(*series_aggregates(approximate=approximate, **columns)).drop("__w")


def load(spark: SparkSession, least: float, most: float, step: float, every: int, ceiling: int = 1000) -> DataFrame:
    """Requests at a rate that rises by step: the rate source ticks at `ceiling`, and a tick is kept when the
    schedule's running count of requests passes a whole number."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", ceiling).load()
    at = F.col("value") / ceiling
    qps = lambda t: F.least(F.lit(least) + F.floor(t / every) * F.lit(step), F.lit(most))
    return ticks.where(F.floor(at * qps(at)) > F.floor((at - 1 / ceiling) * qps(at))).select("timestamp", qps(at).alias("qps"))


def append_feedback(stream: DataFrame, checkpoint: str, table: str = TABLE) -> StreamingQuery:
    """Feedback rows (audio_id, feedback) into the table, batch by batch, with ids in turn; a batch that is retried replaces itself."""
    stream_name = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    return stream.writeStream.foreachBatch(lambda df, n: append(df, table, batch=f"{stream_name}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_logs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def console(stream: DataFrame) -> StreamingQuery:
    return stream.writeStream.format("console").option("truncate", "false").start()

"""Embedding matrices as tables of (id, embedding)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.functions.signal import histogram_bin, mix_vectors


def row_of(matrix: DataFrame, id: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The vector of one id: the filter reaches the scan."""
    return matrix.where(F.col(key) == id).select(F.col(vector).alias("vector"))


def sweep(matrix: DataFrame, first: int, second: int, steps: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """step 0 to steps - 1 and the mix of two rows with weight step / steps on the first."""
    a, b = row_of(matrix, first, key, vector).withColumnRenamed("vector", "a"), row_of(matrix, second, key, vector).withColumnRenamed("vector", "b")
    both = a.crossJoin(F.broadcast(b)).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return both.select("step", mix_vectors(F.col("a"), F.col("b"), F.col("step") / steps).alias("embedding"))


def replace_row(matrix: DataFrame, id: int, new: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The matrix with one row overwritten."""
    return matrix.withColumn(vector, F.when(F.col(key) == id, new).otherwise(F.col(vector)))


def value_histogram(rows: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin, lo, hi and count of equal-width bins from the least value to the greatest; empty bins are reported."""
    bounds = rows.agg(F.min(value).alias("min"), F.max(value).alias("max"))
    counted = rows.select(value).crossJoin(F.broadcast(bounds)).groupBy(histogram_bin(F.col(value), F.col("min"), F.col("max"), bins).alias("bin")).agg(F.count(value).alias("n"))
    spine = bounds.where("min IS NOT NULL").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("max") - F.col("min")) / bins
    return spine.join(counted, "bin", "left").select("bin", (F.col("min") + F.col("bin") * width).alias("lo"), (F.col("min") + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))

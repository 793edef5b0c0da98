"""The speaker dimension, and lookups against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.functions.speaker_values import SPEAKERS
from auralake.operators.metrics import pick


def speakers(spark: SparkSession) -> DataFrame:
    """One row a tag. Where two share a display name the later one is what the name stands for (effective)."""
    last = {name: tag for name, tag, _ in SPEAKERS}
    rows = [(name, tag, texts, last[name] == tag) for name, tag, texts in SPEAKERS]
    return spark.createDataFrame(rows, "display_name string, speaker_id string, sample_texts array<string>, effective boolean")


def names(spark: SparkSession) -> DataFrame:
    return speakers(spark).where("effective").select("display_name")


def with_speaker(requests: DataFrame, known: DataFrame, name: str = "speaker", default: str | None = None) -> DataFrame:
    """speaker_id for each request, `default` where the name is not known; the dimension is a fixed few rows."""
    found = known.where("effective").select(F.col("display_name").alias(name), "speaker_id")
    return requests.join(F.broadcast(found), name, "left").withColumn("speaker_id", F.coalesce("speaker_id", F.lit(default)))


def rejected(requests: DataFrame, known: DataFrame, name: str = "speaker") -> DataFrame:
    """Requests for speakers that are not known, with the reason."""
    return requests.join(F.broadcast(known.where("effective").select(F.col("display_name").alias(name))), name, "left_anti").withColumn("reason", F.concat(F.lit("unsupported speaker: "), F.coalesce(name, F.lit("none"))))


def sample_text(requests: DataFrame, known: DataFrame, key: Column, name: str = "speaker") -> DataFrame:
    """speaker_text: one of the speaker's sample texts, by a hash of the key."""
    found = known.where("effective").select(F.col("display_name").alias(name), "sample_texts")
    return requests.join(F.broadcast(found), name).withColumn("speaker_text", pick(F.col("sample_texts"), key)).drop("sample_texts")

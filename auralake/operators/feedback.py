"""Feedback on audio samples: validation and an append-only table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.operators.idblocks import Claims
from auralake.operators.numbering import numbered
from auralake.scratch import written

TABLE = "real_fake_feedback"


def valid(feedback: DataFrame, samples: DataFrame, audio: str = "audio_id", sample: str = "sample_id") -> DataFrame:
    """Feedback of -1 or 1 on a sample that exists."""
    known = samples.select(F.col(sample).alias(audio)).distinct()
    return feedback.where(F.col("feedback").isin(-1, 1)).join(known, audio, "left_semi")


def invalid(feedback: DataFrame, samples: DataFrame, audio: str = "audio_id", sample: str = "sample_id") -> DataFrame:
    """The other rows, with the reason."""
    known = samples.select(F.col(sample).alias(audio), F.lit(True).alias("__known")).distinct()
    reason = F.when(F.col("__known").isNull(), "unknown sample").when(~F.coalesce(F.col("feedback").isin(-1, 1), F.lit(False)), "feedback is neither -1 nor 1")
    return feedback.join(known, audio, "left").withColumn("reason", reason).where("reason IS NOT NULL").drop("__known")


def create(spark: SparkSession, table: str = TABLE) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (id BIGINT, audio_id STRING, feedback INT, timestamp TIMESTAMP, batch STRING) USING parquet PARTITIONED BY (batch)")


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").collect()
    return rows[0].data_type.rstrip("/")


def append(feedback: DataFrame, table: str = TABLE, now: str | None = None, batch: str = "direct") -> None:
    """Add rows (audio_id, feedback) with ids of a block of their own; any number of writers may do so at once.

    The block is reserved before rows are written (idblocks), and ids are dense within it, by dense numbers that no
    sample's votes hold up. Rows are written beside the table and become its partition by one rename, so an append is
    there as a whole or not at all. A batch of a name of its own replaces what the same batch wrote before and
    has the same ids again, so that a retry leaves it once; other appends have a name each.
    """
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError("a batch is named by letters, digits, _ and -")
    spark = feedback.sparkSession
    create(spark, table)
    name = batch if batch != "direct" else f"direct-{uuid.uuid4().hex}"
    place, own = _location(spark, table), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    rows = written(feedback.select("audio_id", F.col("feedback").cast("int").alias("feedback")))
    n = rows.count()
    first = Claims(spark, f"{place}/_ids").reserve(n, name, lambda: _before(spark, table)) if n else 0
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    out = numbered(rows, ["audio_id", "feedback"], "id", first).select("id", "audio_id", "feedback", at.alias("timestamp"))
    part, final = f"{place}/_new-{uuid.uuid4().hex}", f"{place}/batch={name}"
    out.write.parquet(part)
    where = own(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if where.exists(own(final)):
        where.delete(own(final), True)
    if not where.rename(own(part), own(final)):
        raise RuntimeError(f"{part} could not be renamed to {final}")
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (batch = '{name}')")
    spark.catalog.refreshTable(table)


def _before(spark: SparkSession, table: str) -> int:
    """The first id of a table that has rows but no claims yet: the one behind its last."""
    return spark.table(table).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1


def tally(feedback: DataFrame) -> DataFrame:
    """Votes for and against each sample."""
    return feedback.groupBy("audio_id").agg(F.count_if(F.col("feedback") == 1).alias("real"), F.count_if(F.col("feedback") == -1).alias("fake"))

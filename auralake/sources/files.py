"""Readers: prompts, request and log records, arrays, waveforms, directories.

Content columns are read only where they are selected; paths alone cost a listing.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.functions.text import sample_id, strip, suffix
from auralake.sources import riff

AUDIO_SUFFIXES = (".wav", ".mp3", ".m4a")

RESULT_SCHEMA = "request_id string, text string, start_time double, end_time double, response_time double, status int, error string, audio_path string, metrics string, timestamp timestamp_ntz"
METRICS_SCHEMA = "time_to_first_token array<double>, time_to_last_token array<double>, time_to_encode_audio double, time_to_decode_audio double, input_tokens array<int>, decoding_tokens array<int>, generate_end_to_end_time double, end_to_end_time double"
REQUEST_SCHEMA = "text string, speaker string"
LOG_SCHEMA = "timestamp string, level string, logger string, filename string, line_number int, message string, thread_id bigint, process_id bigint, exception string, request_id string"
METADATA_SCHEMA = "audio_path string, raw_text string, acoustic_tokens string"
SPEED_SCHEMA = "time_to_first_token double, time_to_last_token double, input_tokens bigint, output_tokens bigint, total_tokens bigint, toks_per_s double, gen_toks_per_s double"


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """One prompt a line, stripped, without blank lines."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records of one JSON object a line. Strict: a bad line fails the read; else it is kept as _corrupt."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(f"{schema}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def logs(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, LOG_SCHEMA, strict=False)


def literal(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A frame from columns."""
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def records(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A frame from records under an explicit schema: nothing is inferred from what happens to be null."""
    return spark.createDataFrame(rows, T.StructType.fromDDL(schema))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def sample_ids(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """Names of the samples under a folder, without reading them."""
    return files(spark, folder, pattern).select(sample_id(F.col("path")).alias("sample_id"))


def allowed(uploads: DataFrame, path: str = "path") -> DataFrame:
    """Uploads with an audio suffix."""
    return uploads.where(suffix(F.col(path)).isin(*AUDIO_SUFFIXES))


def refused(uploads: DataFrame, path: str = "path") -> DataFrame:
    return uploads.where(~suffix(F.col(path)).isin(*AUDIO_SUFFIXES)).withColumn("reason", F.concat(F.lit("unsupported file type: "), suffix(F.col(path))))


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _npy(content: Column, whole: bool) -> Column:
    @F.pandas_udf(_struct(data=T.ArrayType(T.LongType() if whole else T.DoubleType()), shape=T.ArrayType(T.IntegerType())))
    def run(content: pd.Series) -> pd.DataFrame:
        loaded = [np.load(io.BytesIO(c), allow_pickle=False) for c in content]
        if whole and any(a.dtype.kind not in "biu" for a in loaded):
            raise ValueError("an array of whole numbers was asked for")
        return pd.DataFrame({"data": [a.astype(np.int64 if whole else float).ravel() for a in loaded], "shape": [list(a.shape) for a in loaded]})

    return run(content)


@F.pandas_udf(_struct(**{n: T.ArrayType(T.LongType()) for n in ("TEXT", "SEMANTIC", "ACOUSTIC")}))
def _npz(content: pd.Series) -> pd.DataFrame:
    names, rows = ("TEXT", "SEMANTIC", "ACOUSTIC"), []
    for c in content:
        with np.load(io.BytesIO(c), allow_pickle=False) as z:
            rows.append([z[n].astype(np.int64).ravel() if n in z else None for n in names])
    return pd.DataFrame(rows, columns=list(names))


@F.pandas_udf(_struct(wave=T.ArrayType(T.ArrayType(T.FloatType())), rate=T.IntegerType(), reason=T.StringType()))
def _wav(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        try:
            wave, rate = riff.parse(c if c is not None else b"")
            rows.append(([ch.astype(np.float32) for ch in wave], rate, None))
        except riff.Unreadable as why:
            rows.append((None, None, str(why)))
    return pd.DataFrame(rows, columns=["wave", "rate", "reason"]).astype({"rate": "Int32"})


def npy(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """path, data (row-major) and shape of dense arrays: as doubles, or as longs, for codes and ids, if whole."""
    return files(spark, path, "*.npy").select("path", _npy(F.col("content"), whole).alias("a")).select("path", "a.*")


def npz(spark: SparkSession, path: str) -> DataFrame:
    """path and the arrays TEXT, SEMANTIC and ACOUSTIC of prompt bundles; null where a bundle lacks one."""
    return files(spark, path, "*.npz").select("path", _npz("content").alias("a")).select("path", "a.*")


def wav(spark: SparkSession, path: str) -> DataFrame:
    """path, wave[channel][sample] in -1 to 1 and rate of RIFF files, or the reason why there is none."""
    return files(spark, path, "*.wav").select("path", _wav("content").alias("a")).select("path", "a.*")


def wave_of(content: Column) -> Column:
    """struct(wave, rate, reason) of the bytes of a RIFF file."""
    return _wav(content)

"""Writers: tables as CSV and JSON, waveforms, files by row, responses, logs."""

from __future__ import annotations

import io
import uuid
import wave as wavelib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from auralake.operators.numbering import numbered
from auralake.sources.stores import store


def csv(df: DataFrame, path: str) -> None:
    """CSV with a header; structs, arrays and maps as JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = [F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.csv(path, header=True)


def csv_indexed(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV whose first column is the row's number from 0 in an order; files follow the order, and each is sorted."""
    found = numbered(df, order, "row_id")
    csv(found.select("row_id", *df.columns).repartitionByRange("row_id").sortWithinPartitions("row_id"), path)


def settings(df: DataFrame, path: str) -> None:
    """A few settings as one JSON file."""
    df.coalesce(1).write.json(path, ignoreNullFields=False)


def logs(df: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    df.write.option("maxRecordsPerFile", rows_a_file).mode("append").json(path)


def bundles(df: DataFrame, path: str) -> None:
    """Prompt bundles: structs of 64-bit arrays."""
    df.select(*(F.col(c).cast("array<bigint>").alias(c) for c in ("TEXT", "SEMANTIC", "ACOUSTIC"))).write.parquet(path)


@F.pandas_udf(T.BinaryType())
def wav_bytes(wave: pd.Series, rate: pd.Series) -> pd.Series:
    """16-bit PCM of wave[channel][sample] in -1 to 1; what lies beyond is clipped."""
    out = []
    for channels, r in zip(wave, rate, strict=True):
        if channels is None:
            out.append(None)
            continue
        x = np.array([np.asarray(c, float) for c in channels])
        buffer = io.BytesIO()
        with wavelib.open(buffer, "wb") as w:
            w.setnchannels(max(1, len(x)))
            w.setsampwidth(2)
            w.setframerate(int(r))
            w.writeframes(np.clip(np.round(x.T * 32767), -32768, 32767).astype("<i2").tobytes())
        out.append(buffer.getvalue())
    return pd.Series(out)


def encode(wave: Column, rate: Column, make: Callable[[], Callable[[np.ndarray, int], bytes]]) -> Column:
    """Bytes by an encoder of the caller's (such as MP3): make() is called once a batch stream."""

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = make()
        for waves, rates in batches:
            yield pd.Series([None if w is None else encoder(np.array([np.asarray(c) for c in w]), int(r)) for w, r in zip(waves, rates, strict=True)])

    return run(wave, rate)


def response(rows: DataFrame, audio: str = "audio", metrics: str = "metrics", id: str = "request_id", mime: str = "audio/wav") -> DataFrame:
    """What a server answers: the audio, and the request's id and metrics as headers."""
    return rows.select(F.col(id).alias("request_id"), F.col(audio).alias("audio"), F.lit(mime).alias("content_type"), F.to_json(metrics, {"ignoreNullFields": "false"}).alias("metrics_json"))


def with_request_id(rows: DataFrame) -> DataFrame:
    """A random id for each request; it differs between runs, so it is for rows that are then written."""
    return rows.withColumn("request_id", F.uuid())


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        where, folder = store(self.path)
        folder = folder.rstrip("/")
        where.create_dir(folder, recursive=True)
        for row in iterator:
            if row.name is None or row.content is None:
                continue
            if not row.name or "/" in row.name or row.name in (".", ".."):
                raise ValueError(f"not a file name: {row.name!r}")
            part = f"{folder}/.{uuid.uuid4().hex}.part"
            with where.open_output_stream(part, compression=None) as out:
                out.write(bytes(row.content))
            where.move(part, f"{folder}/{row.name}")
        return WriterCommitMessage()


class _Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options["path"])


def file_of_each(rows: DataFrame, path: str, name: Column, content: Column) -> None:
    """One file for each row in a folder: its name, and its bytes (such as wav_bytes or encode make).

    A task writes a file under a name of its own and then moves it into place, so no file is ever seen in
    part, and a task that runs again writes the same files. Rows without a name or bytes make none. Names
    are plain file names; of rows that share one, any one's file stays.
    """
    rows.sparkSession.dataSource.register(_Files)
    rows.select(name.alias("name"), content.alias("content")).write.format("row_files").mode("append").save(path)

"""What the operators of this subpackage share: tables, written cuts of lineage (auralake.scratch), chunks of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.config import ship
from auralake.scratch import written as cut

__all__ = ["CHUNK_BYTES", "chunks", "columns_text", "cut", "flat", "small", "table"]

#: Bytes of text that the numpy kernels take at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of values that a side of a join may have to be broadcast.
BROADCAST_BYTES = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (already cut) marked for broadcast if its values take at most `most` bytes; else as it is, for a shuffled join.

    Its values are counted at 16 bytes each and a string's own, which is about what they take in memory,
    elements of an array at 32.
    """

    def extra(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        return F.coalesce(F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 32 if kind.startswith("array") else F.lit(0), F.lit(0))

    values = [F.lit(16) + extra(n, k) for n, k in df.dtypes]
    size = df.agg(F.coalesce(F.sum(sum(values, F.lit(0)).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def columns_text(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls: a null text counts as the empty one."""
    return pc.fill_null(batch.column(name), "")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets into them."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64) if offsets is not None else np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about `most` bytes."""
    raw, offs = flat(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j

"""Large tar shards read by many tasks: an index of samples, then byte ranges of whole samples.

The index is one pass over the headers of each shard, which seeks from header to header and reads no
content: a row for each sample with the bytes it lies in. A range takes the samples that begin in its
`split` bytes, up to the end of the last one, so a sample that straddles a border belongs to the range where it
begins, and no byte is read twice. A task opens the shard at its range and nowhere else. A compressed
shard has no places to begin at and is one range.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from auralake.config import ship
from auralake.scratch import written
from auralake.sources.shards import SCHEMA, Shard, ShardReader, sample_name, samples
from auralake.sources.stores import store

INDEX = "path string, key string, start long, end long, members int"
#: Bytes of a range, and of the samples that go to Spark at once.
SPLIT, BATCH = 256 << 20, 16 << 20
_BLOCK = 512


def walk(stream: io.IOBase) -> Iterator[tuple[str, int, int, int]]:
    """(key, start, end, members) of each sample of a plain tar; start is where its first header, or what extends it, begins."""
    now = None
    with tarfile.open(fileobj=stream, mode="r:") as tar:
        for entry in tar:
            tar.members = []  # the library would keep them all
            if not entry.isfile():
                continue
            key, end = sample_name(entry.name)[0], entry.offset_data + -(-entry.size // _BLOCK) * _BLOCK
            if now and now[0] == key:
                now = (key, now[1], end, now[3] + 1)
                continue
            if now:
                yield now
            now = (key, entry.offset, end, 1)
    if now:
        yield now


class IndexReader(ShardReader):
    """One task for each shard, which reads its headers."""

    def read(self, partition: Shard) -> Iterator[tuple]:
        with partition.where.open_input_file(partition.path) as stream:
            try:
                found = walk(stream)
                first = next(found, None)
            except tarfile.ReadError:
                yield partition.path, None, 0, None, None
                return
            if first:
                yield (partition.path, *first)
            for sample in found:
                yield (partition.path, *sample)


class ShardIndex(DataSource):
    """spark.read.format("tar_index").load(path): a row for each sample; one without key and end for a compressed shard."""

    @classmethod
    def name(cls) -> str:
        return "tar_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options["path"])


def index(spark: SparkSession, path: str) -> DataFrame:
    """The samples of all shards that a path stands for; to be written once and kept beside the shards, if they are read often."""
    ship(spark)
    spark.dataSource.register(ShardIndex)
    return spark.read.format("tar_index").load(path)


def split_ranges(found: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, start and end of each range, and how many samples begin in it."""
    return found.groupBy("path", F.floor(F.col("start") / split).alias("part")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("key").alias("samples")).drop("part")


class _Window(io.RawIOBase):
    """The bytes start to end of a file, as a stream of their own."""

    def __init__(self, stream, start: int, end: int | None):
        self.stream, self.left = stream, None if end is None else end - start
        stream.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        n = len(buffer) if self.left is None else min(len(buffer), self.left)
        got = self.stream.read(n) if n else b""
        buffer[: len(got)] = got
        if self.left is not None:
            self.left -= len(got)
        return len(got)


def read_range(base: str, path: str, start: int, end: int | None) -> Iterator[tuple[str, dict[str, bytes]]]:
    """The samples of one range; base tells the store that the path is in."""
    where, _ = store(base)
    with where.open_input_file(path) as stream, io.BufferedReader(_Window(stream, start, end), 1 << 20) as own:
        with tarfile.open(fileobj=own, mode="r|*" if end is None else "r|") as tar:
            yield from samples(tar)


def read(spark: SparkSession, path: str, split: int = SPLIT, found: DataFrame | None = None) -> DataFrame:
    """key and members of all samples of the shards, each range in a task of its own; found: an index made before.

    What a task holds is one batch of samples, `BATCH` bytes or one sample.
    """
    parts = written(split_ranges(found if found is not None else index(spark, path), split))
    base = path if "://" in path else "/"

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.map_(pa.string(), pa.binary())]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kinds[0]), pa.array([list(m.items()) for _, m in rows], kinds[1])], names=["key", "members"])

        for ranges in batches:
            for r in ranges.to_pylist():
                rows, held = [], 0
                for key, members in read_range(base, r["path"], r["start"], r["end"]):
                    rows.append((key, members))
                    held += sum(map(len, members.values()))
                    if held >= BATCH:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    tasks = max(1, parts.count())
    # About a range a task, and the same one if a task runs again.
    dealt = parts.select("path", "start", "end").repartitionByRange(tasks, "path", "start")
    return dealt.mapInArrow(loaded, SCHEMA)

"""Tar shards of samples as a Spark data source, for reading and writing.

A sample is a key and its members by suffix: files a.json and a.wav of a shard are key a with members
json and wav. A shard is one input partition; a task writes its rows to shards that close once they
hold `maxsize` bytes. Names may hold ranges in braces, as in shard-{000000..000011}.tar, and wildcards.
Paths are URIs of any store that stores.store() opens.
"""

from __future__ import annotations

import io
import os
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from auralake.sources.stores import is_folder, matching, store

SCHEMA = "key string, members map<string, binary>"


def expand(name: str) -> list[str]:
    """The names that one with ranges in braces stands for."""
    found = re.search(r"\{(\d+)\.\.(\d+)\}", name)
    if not found:
        return [name]
    lo, hi = found.groups()
    return [x for i in range(int(lo), int(hi) + 1) for x in expand(name[: found.start()] + str(i).zfill(len(lo)) + name[found.end() :])]


@dataclass
class Shard(InputPartition):
    where: FileSystem
    path: str


def sample_name(name: str) -> tuple[str, str]:
    """The key of a member's name and its suffix in lower case: all after the first dot of the file's own name."""
    folder, own = os.path.split(name)
    stem, _, suffix = own.partition(".")
    return os.path.join(folder, stem), suffix.lower()


def samples(tar: tarfile.TarFile) -> Iterator[tuple[str, dict[str, bytes]]]:
    """(key, members) of the samples of an open tar, as they come."""
    key, members = None, {}
    for entry in tar:
        tar.members = []  # the library would keep them all
        if not entry.isfile():
            continue
        own, suffix = sample_name(entry.name)
        if key is not None and own != key:
            yield key, members
            members = {}
        key = own
        members[suffix] = tar.extractfile(entry).read()
    if key is not None:
        yield key, members


class ShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Shard]:
        names = expand(self.path)
        if names == [self.path] and not re.search(r"[*?\[]", self.path) and is_folder(self.path):
            names = [f"{self.path.rstrip('/')}/*.tar"]
        return [Shard(*found) for name in names for found in matching(name)]

    def read(self, partition: Shard) -> Iterator[tuple]:
        with partition.where.open_input_stream(partition.path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            yield from samples(tar)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ShardWriter(DataSourceWriter):
    """Tasks write under temporary names; the driver renames what the tasks that counted have written."""

    def __init__(self, path: str, maxsize: int):
        self.path, self.maxsize = path, maxsize

    def write(self, iterator: Iterator) -> Written:
        where, folder = store(self.path)
        where.create_dir(folder, recursive=True)
        run, files, tar, stream, held = uuid.uuid4().hex, [], None, None, 0
        for row in iterator:
            size = sum(len(b) for b in (row.members or {}).values())
            if tar is not None and held + size > self.maxsize:
                tar.close()
                stream.close()
                tar = None
            if tar is None:
                final = f"{folder.rstrip('/')}/shard-{run}-{len(files):06d}.tar"
                files.append((f"{final}.part", final))
                stream = where.open_output_stream(files[-1][0], compression=None)
                tar, held = tarfile.open(fileobj=stream, mode="w|"), 0
            for suffix, content in sorted((row.members or {}).items()):
                entry = tarfile.TarInfo(f"{row.key}.{suffix}")
                entry.size = len(content)
                tar.addfile(entry, io.BytesIO(content))
            held += size
        if tar is not None:
            tar.close()
            stream.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        where, _ = store(self.path)
        for m in messages:
            for part, final in m.files if m else []:
                where.move(part, final)

    def abort(self, messages: list) -> None:
        where, _ = store(self.path)
        for m in messages:
            for part, _ in m.files if m else []:
                if where.get_file_info(part).type == FileType.File:
                    where.delete_file(part)


class Shards(DataSource):
    """spark.read.format("tar_shards").load(path); df.write.format("tar_shards").option("maxsize", n).save(path)."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("maxsize", 1_000_000_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Shards)


def raw_text(members: Column) -> Column:
    """The text of a sample's JSON member."""
    return F.get_json_object(F.element_at(members, "json").cast("string"), "$.raw_text")


def member(members: Column, suffix: str) -> Column:
    return F.try_element_at(members, F.lit(suffix))


def replace_member(members: Column, old: str, new: str, content: Column) -> Column:
    """The members with `old` gone and `new` added."""
    return F.map_concat(F.map_filter(members, lambda k, _: ~k.isin(old, new)), F.create_map(F.lit(new), content))

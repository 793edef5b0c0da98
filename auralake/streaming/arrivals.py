"""Arrivals as a stream: files that come into a folder, as uploads or as tar shards, once each.

spark.readStream.format("arrivals").option("log", folder).load(path): `kind` is upload (a row for each file: path, content) or
shards (a row for each sample: key, members); `suffixes` are those that are let in, as in wav,mp3.

An offset is the number of entries of a log, which the source keeps in a folder of its own. An entry
names the files that were new when it was made and appears under its number as a whole: it is written beside and
renamed. So a batch that is run again after a failure reads the same files, whatever came meanwhile and
whatever their times say; a query that starts from its checkpoint goes on behind what it has read, and one
with a new checkpoint begins with the first entry. Names that begin with . or _ or end in .part are still being
written. A log belongs to one query: two that share one would each see what the other has found, too.

`commit` packs entries that every later run is done with into one, so a log has few files; entries are
not forgotten, as a file may only count as new once.
"""

from __future__ import annotations

import json
import tarfile
import uuid
from collections.abc import Iterator

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from auralake.config import ship
from auralake.sources import shards
from auralake.sources.stores import store

SCHEMAS = {"upload": "path string, content binary", "shards": shards.SCHEMA}
#: Entries that are packed into one at a time.
PACK = 50


class Log:
    """Numbered entries, each a list of files, in a folder of any store: n.json for one, a-b.json for those from a to b."""

    def __init__(self, uri: str):
        self.where, self.folder = store(uri)
        self.where.create_dir(self.folder, recursive=True)

    def _files(self) -> list[tuple[int, int, str]]:
        """(first, last, path) in order, without those that a packed one covers."""
        found = []
        for info in self.where.get_file_info(FileSelector(self.folder)):
            stem, dot, suffix = info.base_name.partition(".")
            if suffix == "json" and info.type == FileType.File:
                first, _, last = stem.partition("-")
                found.append((int(first), int(last or first), info.path))
        found.sort(key=lambda f: (f[0], -f[1]))
        kept, until = [], 0
        for f in found:
            if f[1] > until:
                kept.append(f)
                until = f[1]
        return kept

    def entries(self, after: int = 0, until: int | None = None) -> list[list[str]]:
        """The files of each entry after < number <= until."""
        out = []
        for first, last, path in self._files():
            if last <= after or (until is not None and first > until):
                continue
            with self.where.open_input_stream(path) as f:
                lists = json.loads(f.read())
            out += [files for n, files in enumerate(lists, first) if n > after and (until is None or n <= until)]
        return out

    def last(self) -> int:
        return max((last for _, last, _ in self._files()), default=0)

    def _put(self, name: str, lists: list[list[str]]) -> None:
        part = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.where.open_output_stream(part) as f:
            f.write(json.dumps(lists).encode())
        self.where.move(part, f"{self.folder}/{name}.json")

    def add(self, files: list[str]) -> int:
        n = self.last() + 1
        self._put(f"{n:012d}", [files])
        return n

    def pack(self, until: int) -> None:
        """One file for all whole entries up to `until`; what it covers is removed after it is there."""
        own = [f for f in self._files() if f[1] <= until]
        if len(own) < PACK:
            return
        self._put(f"{own[0][0]:012d}-{own[-1][1]:012d}", self.entries(own[0][0] - 1, own[-1][1]))
        for _, _, path in own:
            self.where.delete_file(path)


class Arrived(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, path: str, log: str, kind: str, suffixes: tuple[str, ...]):
        self.path, self.log_uri, self.kind, self.suffixes = path, log, kind, suffixes

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @property
    def log(self) -> Log:
        if "_log" not in self.__dict__:
            self._log = Log(self.log_uri)
        return self._log

    def _present(self) -> list[str]:
        where, folder = store(self.path)
        found = where.get_file_info(FileSelector(folder, recursive=True, allow_not_found=True))
        return sorted(i.path for i in found if i.type == FileType.File and not i.base_name.startswith((".", "_")) and not i.base_name.endswith(".part") and (not self.suffixes or i.extension.lower() in self.suffixes))

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        log = self.log
        if "_seen" not in self.__dict__:
            self._seen, self._entry = {f for files in log.entries() for f in files}, log.last()
        new = [f for f in self._present() if f not in self._seen]
        if new:
            self._entry = log.add(new)
            self._seen.update(new)
        return {"entry": self._entry}

    def partitions(self, start: dict, end: dict) -> list[Arrived]:
        return [Arrived(f) for files in self.log.entries(start["entry"], end["entry"]) for f in files]

    def commit(self, end: dict) -> None:
        self.log.pack(end["entry"] - 1)

    def read(self, partition: Arrived) -> Iterator[tuple]:
        where: FileSystem = store(self.path)[0]
        with where.open_input_stream(partition.path, compression=None) as stream:
            if self.kind == "upload":
                yield partition.path, stream.read()
                return
            with tarfile.open(fileobj=stream, mode="r|*") as tar:
                yield from shards.samples(tar)


class Arrivals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrivals"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "upload")]

    def streamReader(self, schema) -> ArrivalReader:
        suffixes = tuple(s.strip().lower() for s in self.options.get("suffixes", "").split(",") if s.strip())
        return ArrivalReader(self.options["path"], self.options["log"], self.options.get("kind", "upload"), suffixes)


def arrivals(spark: SparkSession, path: str, log: str, kind: str = "upload", suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The stream of what comes into a folder; log: a folder of its own, kept as long as the query's checkpoint."""
    ship(spark)
    spark.dataSource.register(Arrivals)
    return spark.readStream.format("arrivals").option("log", log).option("kind", kind).option("suffixes", ",".join(suffixes)).load(path)

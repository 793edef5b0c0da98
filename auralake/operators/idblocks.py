"""Blocks of ids for writers that work side by side, reserved by a commit that only one of them can make.

A folder holds one claim for each block: a file named by the block's first id, with the number of ids and who
has it. A writer reads where the last block ends and puts its claim there, whole and only if no file of that name
exists; who comes second finds one, reads again and goes on behind it. So blocks never overlap and leave no ids between
them. A name that has claimed a block before, as a batch that is run again, gets the same block.

On a local file system a claim is a hard link, elsewhere a rename that does not overwrite: stores in which
neither is atomic, as plain object stores, must not be used for the claims.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Claims:
    """The claims in a folder of the store that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.path = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs.mkdirs(self.path)

    def _child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def held(self) -> list[tuple[int, int, str]]:
        """(first id, ids, name) of all claims, in order."""
        if self.local:
            folder, out = self.path.toUri().getPath(), []
            for name in os.listdir(folder):
                if name.endswith(".claim"):
                    with open(os.path.join(folder, name)) as f:
                        out.append((int(name.partition(".")[0]), *json.load(f)))
            return sorted(out)
        out = []
        for status in self.fs.listStatus(self.path):
            name = status.getPath().getName()
            if name.endswith(".claim"):
                stream = self.fs.open(status.getPath())
                content = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                out.append((int(name.partition(".")[0]), *json.loads(content)))
        return sorted(out)

    def _put(self, first: int, n: int, name: str) -> bool:
        """Whether the claim could be made: no file of its name was there."""
        part, final, content = f".{uuid.uuid4().hex}", f"{first:020d}.claim", json.dumps([n, name])
        if self.local:
            folder = self.path.toUri().getPath()
            own = os.path.join(folder, part)
            with open(own, "w") as f:
                f.write(content)
            try:
                os.link(own, os.path.join(folder, final))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
        stream = self.fs.create(self._child(part), False)
        stream.write(bytearray(content.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._child(part), self._child(final), options)
            return True
        except Exception:
            if self.fs.exists(self._child(final)):
                self.fs.delete(self._child(part), False)
                return False
            raise

    def reserve(self, n: int, name: str, start: Callable[[], int] = lambda: 1) -> int:
        """The first of n ids that no other name has; the same one again for a name that has n of them. start: the first id of all."""
        while True:
            held = self.held()
            for first, size, owner in held:
                if owner == name and size == n:
                    return first
            first = held[-1][0] + held[-1][1] if held else start()
            if self._put(first, n, name):
                return first

"""Files by URI, wherever they lie: a local folder, or a store that pyarrow opens (hdfs://, s3://, gs://).

For the data sources whose Python tasks open files themselves. A name without a scheme is local, and has
to be in a folder that the driver and all executors share.
"""

from __future__ import annotations

import glob
import os
import re

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path within it."""
    return fs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][\w+.-]*:/", uri) else os.path.abspath(uri))


def matching(uri: str) -> list[tuple[fs.FileSystem, str]]:
    """The files that a URI with * ? [ ] in its path stands for, in order of their names; without these, itself."""
    head = re.split(r"[*?\[]", uri, maxsplit=1)[0]
    if head == uri:
        return [store(uri)]
    folder, _, first = head.rpartition("/")
    rest = first + uri[len(head) :]
    where, base = store(folder or ("/" if head.startswith("/") else "."))
    base = base.rstrip("/")
    own = re.compile(glob.translate(rest))
    found = where.get_file_info(fs.FileSelector(base, recursive="/" in rest, allow_not_found=True))
    return [(where, i.path) for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and own.match(i.path[len(base) + 1 :])]


def is_folder(uri: str) -> bool:
    where, path = store(uri)
    return where.get_file_info(path).type == fs.FileType.Directory

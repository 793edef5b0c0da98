import io
import tarfile

import pytest
from pyspark.sql import functions as F

from auralake.sources import ranges, shards


def content(i: int, suffix: str) -> bytes:
    return f"{i}{suffix}".encode() * (i * 37 % 211)


def make(path, n: int, fmt=tarfile.PAX_FORMAT, mode: str = "w", top: str = "folder") -> dict:
    """Samples of different sizes, with folders between, long names, members of no bytes and a tar in a tar."""
    want = {}
    with tarfile.open(path, mode, format=fmt) as tar:
        for i in range(n):
            key = f"{top}{i % 3}/s{i:05d}" + ("x" * 180 if i % 10 == 0 else "") + ("é" if i % 17 == 0 else "")
            if i % 5 == 0:
                tar.addfile(_folder(f"folder{i}"))
            for suffix in ("json", "wav", "seg.TXT")[: 1 + i % 3]:
                body = content(i, suffix)
                if i == 8 and suffix == "json":
                    inner = io.BytesIO()
                    with tarfile.open(fileobj=inner, mode="w") as t:
                        e = tarfile.TarInfo("fake.json")
                        e.size = 4
                        t.addfile(e, io.BytesIO(b"fake"))
                    body = inner.getvalue()
                entry = tarfile.TarInfo(f"{key}.{suffix}")
                entry.size = len(body)
                tar.addfile(entry, io.BytesIO(body))
                want.setdefault(key, {})[suffix.lower()] = body
    return want


def _folder(name):
    entry = tarfile.TarInfo(name)
    entry.type = tarfile.DIRTYPE
    return entry


def of(df) -> dict:
    return {r.key: {k: bytes(v) for k, v in r.members.items()} for r in df.collect()}


@pytest.mark.parametrize("fmt", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
@pytest.mark.parametrize("split", [512, 20_000, 1 << 30])
def test_one_shard_by_many_tasks_equals_the_whole(spark, tmp_path, fmt, split):
    want = make(tmp_path / "a.tar", 120, fmt)
    df = ranges.read(spark, str(tmp_path / "a.tar"), split)
    assert of(df) == want and df.count() == len(want)
    tasks = df.select(F.spark_partition_id()).distinct().count()
    assert tasks > 20 if split == 512 else tasks >= 5 if split == 20_000 else tasks == 1
    shards.register(spark)
    assert of(spark.read.format("tar_shards").load(str(tmp_path / "a.tar"))) == want


def test_index_has_each_sample_once_and_ranges_tile(spark, tmp_path):
    want = make(tmp_path / "b.tar", 60)
    rows = ranges.index(spark, str(tmp_path / "b.tar")).orderBy("start").collect()
    assert [r.key for r in rows] == list(want) and [r.members for r in rows] == [len(m) for m in want.values()]
    assert all(a.end <= b.start for a, b in zip(rows, rows[1:]))
    parts = ranges.split_ranges(ranges.index(spark, str(tmp_path / "b.tar")), 4096).orderBy("start").collect()
    assert all(a.end <= b.start for a, b in zip(parts, parts[1:])) and sum(p.samples for p in parts) == len(want)


def test_many_shards_compressed_and_empty_ones(spark, tmp_path):
    want = make(tmp_path / "s-0.tar", 30)
    make(tmp_path / "s-1.tar", 7, mode="w:gz", top="FOLDER")
    with tarfile.open(tmp_path / "s-2.tar", "w"):
        pass
    got = of(ranges.read(spark, str(tmp_path), 8192))
    assert {k: v for k, v in got.items() if k.startswith("folder")} == want
    assert sum(k.startswith("FOLDER") for k in got) == 7


def test_a_kept_index(spark, tmp_path):
    want = make(tmp_path / "c.tar", 20)
    ranges.index(spark, str(tmp_path / "c.tar")).write.parquet(str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index"))
    assert of(ranges.read(spark, str(tmp_path / "c.tar"), 4096, kept.where("members > 1"))).keys() >= {k for k, m in want.items() if len(m) > 1}

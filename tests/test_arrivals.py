import io
import tarfile

import pytest

from auralake.streaming import arrivals as ar
from auralake.streaming import partials as pt


def run(spark, tmp_path, name="q", **how):
    """One run of the query over what is there, from its checkpoint: rows so far."""
    stream = ar.arrivals(spark, str(tmp_path / "in"), str(tmp_path / "log"), **how)
    out = stream.writeStream.format("parquet").option("path", str(tmp_path / f"out-{name}")).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / f"out-{name}")).collect()


def test_each_upload_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    want = {}
    for n in range(4):
        for i in range(3):
            name = f"{n}-{i}.WAV"
            (folder / name).write_bytes(want.setdefault(name, f"{n}.{i}".encode()))
        (folder / f"{n}.txt").write_bytes(b"not let in")
        (folder / f".{n}.wav").write_bytes(b"being written")
        (folder / f"{n}.wav.part").write_bytes(b"being written")
        rows = run(spark, tmp_path, suffixes=("wav",))
        assert {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in rows} == want and len(rows) == len(want)
    assert len(run(spark, tmp_path, suffixes=("wav",))) == len(want)
    # A query with a checkpoint of its own begins with the first entry.
    assert len(run(spark, tmp_path, "other", suffixes=("wav",))) == len(want)


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(b"a")
    seen, fail = [], [True]

    def sink(df, n):
        seen.append((n, sorted(bytes(r.content) for r in df.collect())))
        if fail[0]:
            fail[0] = False
            (tmp_path / "in" / "0.wav").write_bytes(b"0")
            raise RuntimeError("lost")

    def start():
        return ar.arrivals(spark, str(tmp_path / "in"), str(tmp_path / "log")).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    start().awaitTermination()
    start().awaitTermination()
    assert seen == [(0, [b"a"]), (0, [b"a"]), (1, [b"0"])]


def test_shards(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        with tarfile.open(tmp_path / "in" / f"{n}.tar", "w") as tar:
            for i in range(5):
                for suffix in ("json", "wav"):
                    e = tarfile.TarInfo(f"{n}-{i}.{suffix}")
                    e.size = 3
                    tar.addfile(e, io.BytesIO(b"abc"))
        rows = run(spark, tmp_path, kind="shards")
        assert sorted(r.key for r in rows) == sorted(f"{a}-{b}" for a in range(n + 1) for b in range(5)) and all(set(r.members) == {"json", "wav"} for r in rows)


def test_log(tmp_path):
    log = ar.Log(str(tmp_path / "log"))
    for i in range(120):
        assert log.add([f"{i}a", f"{i}b"]) == i + 1
    log.pack(100)
    assert len(log._files()) == 21 and log.last() == 120
    assert log.entries() == [[f"{i}a", f"{i}b"] for i in range(120)]
    assert log.entries(98, 103) == [[f"{i}a", f"{i}b"] for i in range(98, 103)]
    # A crash between the packed file and the removal of what it covers leaves both.
    log._put(f"{101:012d}-{110:012d}", log.entries(100, 110))
    assert log.entries(99, 111) == [[f"{i}a", f"{i}b"] for i in range(99, 111)]
    assert log.add(["x"]) == 121
    log.pack(121)
    assert log.entries(119) == [["119a", "119b"], ["x"]]


PART = "request string, part int, ids array<int>, finished boolean, at timestamp"


def gathered(spark, tmp_path, batches, patience="10 minutes", memory="1 hour"):
    """Rows out after each batch; the query starts anew from its checkpoint for each."""
    made = []
    (tmp_path / "parts").mkdir(exist_ok=True)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for n, rows in enumerate(batches):
        spark.createDataFrame([(r, p, i, f, t) for r, p, i, f, t in rows], "request string, part int, ids array<int>, finished boolean, at string").selectExpr("request", "part", "ids", "finished", "cast(at AS timestamp) at").coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
        stream = spark.readStream.schema(PART).parquet(str(tmp_path / "parts"))
        out = pt.finished_outputs(stream, patience, memory, late="0 seconds")
        out.writeStream.format("parquet").option("path", str(tmp_path / "done")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        made.append(sorted((r.request, list(r.ids), r.parts, r.reason) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "done")).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return made


def at(minute: int, second: int = 0) -> str:
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:{second:02d}"


def test_parts_in_any_order_twice_and_abandoned(spark, tmp_path):
    made = gathered(
        spark,
        tmp_path,
        [
            [("a", 1, [3], False, at(1)), ("a", 0, [1, 2], False, at(1)), ("b", 0, [7], True, at(1)), ("c", 0, [5], False, at(1)), ("c", 2, [9], False, at(1)), ("e", 1, None, True, at(1))],
            [("a", 0, [99], False, at(2)), ("a", 2, [4], True, at(2)), ("b", 0, [7], True, at(2)), ("e", 0, [6], False, at(2))],
            [("tick", 0, [0], True, at(20))],
            [("c", 1, [6], True, at(21)), ("tick2", 0, [0], True, at(21))],
            [("tick3", 0, [0], True, at(200))],
            [("tick4", 0, [0], True, at(201)), ("b", 0, [8], True, at(201))],
        ],
    )
    base = [("b", [7], 1, "finished")]
    assert made[0] == base
    base = sorted([*base, ("a", [1, 2, 3, 4], 3, "finished"), ("e", [6], 2, "finished")])
    assert made[1] == base
    tick = [("tick", [0], 1, "finished")]
    c = [("c", [5], 1, "abandoned")]
    assert made[2] in (sorted(base + tick), sorted(base + tick + c))
    # What comes for c after it was given up is dropped.
    assert made[3] == sorted(base + tick + c + [("tick2", [0], 1, "finished")])
    # b is forgotten after its hour and counts anew.
    assert ("b", [8], 1, "finished") in made[5] and made[5].count(("b", [7], 1, "finished")) == 1 and len(made[5]) == len(made[3]) + 3

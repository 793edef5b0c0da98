import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.operators import feedback
from auralake.sources import files, shards, sinks


def test_prompts(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" one \n\n\ttwo\n   \nthree")
    assert [r.value for r in files.prompts(spark, str(tmp_path)).collect()] == ["one", "two", "three"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"audio_path": "x.wav", "raw_text": "hi", "acoustic_tokens": "x.npy"}) + "\nnot json\n")
    loose = files.json_lines(spark, str(tmp_path), files.METADATA_SCHEMA, strict=False)
    assert sorted(r._corrupt is None for r in loose.collect()) == [False, True]
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path), files.METADATA_SCHEMA).collect()


def test_logs_round_trip(spark, tmp_path):
    rows = files.records(spark, [{"timestamp": "t", "level": "INFO", "message": "m", "line_number": 3, "request_id": "r"}], files.LOG_SCHEMA)
    sinks.logs(rows, str(tmp_path / "l"))
    back = files.logs(spark, str(tmp_path / "l")).first()
    assert (back.level, back.line_number, back.request_id, back._corrupt) == ("INFO", 3, "r", None)


def test_csv_round_trip(spark, tmp_path):
    df = files.literal(spark, {"a": [1, 2], "b": ["x", None]}, "a int, b string").withColumn("m", F.struct(F.lit(1).alias("k"), F.lit(None).cast("int").alias("n")))
    sinks.csv(df, str(tmp_path / "c"))
    back = files.csv(spark, str(tmp_path / "c"), "a int, b string, m string").orderBy("a").collect()
    assert [(r.a, r.b) for r in back] == [(1, "x"), (2, None)]
    sinks.csv_indexed(df.drop("m"), str(tmp_path / "i"), ["a"])
    assert [(r.row_id, r.a) for r in files.csv(spark, str(tmp_path / "i"), "row_id int, a int, b string").collect()] == [(0, 1), (1, 2)]
    sinks.settings(df.limit(1), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.int16).reshape(2, 3))
    np.savez(tmp_path / "b.npz", TEXT=np.array([1, 2]), SEMANTIC=np.array([3]))
    r = files.npy(spark, str(tmp_path)).first()
    assert (r["data"], r["shape"]) == ([0, 1, 2, 3, 4, 5], [2, 3])
    r = files.npz(spark, str(tmp_path)).first()
    assert (r["TEXT"], r["SEMANTIC"], r["ACOUSTIC"]) == ([1, 2], [3], None)
    bundle = files.npz(spark, str(tmp_path)).withColumn("ACOUSTIC", F.array(F.lit(5)))
    sinks.bundles(bundle, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["ACOUSTIC"] == [5]


def test_wav_round_trip(spark, tmp_path):
    wave = [[0.0, 0.5, -0.5, 1.5], [0.25, -0.25, 0.0, -1.0]]
    df = spark.createDataFrame([(wave, 24_000)], "w array<array<double>>, r int")
    payload = df.select(sinks.wav_bytes("w", "r")).first()[0]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "Voice.1.wav").write_bytes(payload)
    got = files.wav(spark, str(tmp_path)).first()
    assert got["rate"] == 24_000
    assert np.abs(np.array(got["wave"]) - np.clip(wave, -1, 1)).max() < 1e-3
    assert files.sample_ids(spark, str(tmp_path)).first()[0] == "Voice.1"
    both = spark.createDataFrame([("a/x.WAV",), ("b/y.txt",), ("z",)], "path string")
    assert files.allowed(both).count() == 1 and files.refused(both).count() == 2


def test_response(spark):
    rows = spark.createDataFrame([(b"x", 1)], "audio binary, n int").withColumn("metrics", F.struct("n", F.lit(None).cast("int").alias("end"))).transform(sinks.with_request_id)
    r = sinks.response(rows).first()
    assert json.loads(r.metrics_json) == {"n": 1, "end": None} and len(r.request_id) == 36
    assert rows.select(sinks.encode(F.array(F.array(F.lit(0.5))), F.lit(8000), lambda: lambda w, r: bytes(str(r), "ascii"))).first()[0] == b"8000"


def test_shards(spark, tmp_path):
    shards.register(spark)
    for i in range(2):
        with tarfile.open(tmp_path / f"in-{i:03d}.tar", "w") as tar:
            for k in range(3):
                for suffix, content in (("json", json.dumps({"raw_text": f"t{i}{k}"}).encode()), ("wav", b"w" * 10)):
                    entry = tarfile.TarInfo(f"s{i}{k}.{suffix}")
                    entry.size = len(content)
                    tar.addfile(entry, io.BytesIO(content))
    df = spark.read.format("tar_shards").load(str(tmp_path / "in-{000..001}.tar"))
    assert df.rdd.getNumPartitions() == 2
    assert sorted(r[0] for r in df.select(shards.raw_text(F.col("members"))).collect()) == ["t00", "t01", "t02", "t10", "t11", "t12"]
    made = df.withColumn("members", shards.replace_member(F.col("members"), "wav", "npy", F.lit(b"123")))
    assert made.select(shards.member(F.col("members"), "wav")).first()[0] is None
    made.write.format("tar_shards").mode("append").option("maxsize", "50").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.tar"))) == 4 and not list((tmp_path / "out").glob("*.part"))
    back = spark.read.format("tar_shards").load(str(tmp_path / "out"))
    assert sorted((r.key, sorted(r.members)) for r in back.collect()) == sorted((f"s{i}{k}", ["json", "npy"]) for i in range(2) for k in range(3))


def test_shards_by_uri(spark, tmp_path):
    shards.register(spark)
    rows = spark.createDataFrame([(f"k{i}", {"bin": bytes([i]) * 1000}) for i in range(5)], shards.SCHEMA).coalesce(1)
    uri = (tmp_path / "far").as_uri()
    rows.write.format("tar_shards").mode("append").option("maxsize", "2000").save(uri)
    for path in (uri, f"{uri}/shard-*.tar", f"{tmp_path.as_uri()}/f*/*.tar", str(tmp_path / "far") + "/"):
        back = spark.read.format("tar_shards").load(path)
        assert {r.key: bytes(r.members["bin"]) for r in back.collect()} == {f"k{i}": bytes([i]) * 1000 for i in range(5)}
        assert back.rdd.getNumPartitions() == 3


def test_file_of_each(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", b"1"), ("b.wav", b""), ("c.wav", None), (None, b"3")], "n string, c binary")
    for _ in range(2):
        sinks.file_of_each(rows, (tmp_path / "out").as_uri(), F.col("n"), F.col("c"))
        assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a.wav": b"1", "b.wav": b""}
    with pytest.raises(Exception, match="not a file name"):
        sinks.file_of_each(rows, str(tmp_path / "out"), F.lit("../x"), F.col("c"))


def test_whole_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([2**53 + 1, -1]))
    assert files.npy(spark, str(tmp_path), whole=True).first()["data"] == [2**53 + 1, -1]


def test_feedback_table(spark):
    spark.sql("DROP TABLE IF EXISTS votes_test")
    rows = spark.createDataFrame([(f"a{i}", 1) for i in range(100)], "audio_id string, feedback int")
    feedback.append(rows, "votes_test", "2024-01-01 00:00:00")
    feedback.append(rows, "votes_test")
    feedback.append(rows.limit(7), "votes_again", batch="s-0")
    for _ in range(2):  # a batch that is tried again has the ids it had
        feedback.append(rows.limit(3), "votes_again", batch="s-1")
    assert sorted(r.id for r in spark.table("votes_again").where("batch = 's-1'").collect()) == [8, 9, 10]
    assert spark.table("votes_again").count() == 10 == spark.table("votes_again").select("id").distinct().count()
    spark.sql("DROP TABLE votes_again")
    got = [r.id for r in spark.table("votes_test").select("id").collect()]
    assert sorted(got) == list(range(1, 201))
    spark.sql("DROP TABLE votes_test")

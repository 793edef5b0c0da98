import json
import time

from pyspark.sql import functions as F

from auralake.operators import metrics, models
from auralake.plans.catalogue import requests
from auralake.streaming import streams

SF = "/root/testdata/sf0.001"


def _drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_equals_batch(spark, tmp_path):
    rows = requests(spark, SF)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _drain(streams.time_series(stream, "10 minutes", approximate=False), "series", "complete")
    rounded = lambda df: df.select(F.col("timestamp").cast("timestamp").alias("t"), "requests_per_s", "attempts_per_s", *(F.round(c, 6).alias(c) for c in ("avg_response_time", "std_response_time", "p95_response_time", "success_rate")))
    got, want = rounded(spark.table("series")), rounded(metrics.time_series(rows, "10 minutes", fill=False))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 100


def test_logs_and_feedback_streams(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.json").write_text("\n".join(json.dumps({"level": "INFO", "message": str(i)}) for i in range(5)))
    q = streams.append_logs(streams.logs(spark, str(tmp_path / "logs")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    spark.sql("DROP TABLE IF EXISTS votes_stream")
    (tmp_path / "votes").mkdir()
    (tmp_path / "votes" / "a.json").write_text("\n".join(json.dumps({"audio_id": f"a{i}", "feedback": 1}) for i in range(7)))
    votes = spark.readStream.schema("audio_id string, feedback int").json(str(tmp_path / "votes"))
    streams.append_feedback(votes, str(tmp_path / "cp2"), "votes_stream").awaitTermination(120)
    assert sorted(r.id for r in spark.table("votes_stream").collect()) == list(range(1, 8))
    spark.sql("DROP TABLE votes_stream")


def test_requests_and_load(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"text": "hi", "speaker": "x"}))
    _drain(streams.requests(spark, str(tmp_path / "r")), "asked", "append")
    assert spark.table("asked").first().text == "hi"
    q = streams.load(spark, 5.0, 10.0, 5.0, 2, ceiling=100).writeStream.format("memory").queryName("load").start()
    time.sleep(6)
    q.stop()
    assert spark.table("load").count() > 5


def test_speak_with_stand_ins(spark):
    marks = {"[text]": 66641, "[convert]": 66642, "[mimi]": 66643, "[stop]": 66644}
    asked = spark.createDataFrame([("Hello,,  World", "[spkr_63]"), ("b", None)], "text string, speaker_id string")
    out = models.speak(asked, models.DoubleTokenizer, lambda: models.DoubleGenerator(66644), models.DoubleCodec, marks).collect()
    assert all(r.valid and len(r.books) == 8 and len(r.wave) == len(r.books[0]) > 0 for r in out)
    assert out[0].prompt[:2] == [66641, ord("h")] and out[0].prompt[-1] == ord("]")
    waves = spark.createDataFrame([([0.0, 0.5, -0.5], 24_000)], "wave array<float>, rate int")
    more = models.continue_audio(waves, lambda: models.DoubleGenerator(66644), models.DoubleCodec, marks).first()
    assert more.prompt[0] == 66643 and len(more.prompt) == 25 and more.valid
    ids = asked.select(models.decode_text(models.encode_text(F.col("text"), models.DoubleTokenizer), models.DoubleTokenizer)).collect()
    assert ids[0][0] == "Hello,,  World"


class Echo:
    """Gives back the source part of its prompt."""

    def generate(self, prompts):
        return [p[1 : p.index(-2)] for p in prompts]


def test_long_generation_covers_the_source(spark):
    rows = spark.createDataFrame([("k", list(range(50))), ("e", [])], "k string, a array<int>")
    out = dict(models.generate_long(rows, "k", "a", Echo, 20, 4, (-1, -2, -3)).collect())
    assert out["e"] == [] and set(out["k"]) == set(range(50))


class Whole:
    """Gives back its whole prompt, then its options."""

    def generate(self, prompts, **options):
        return [p + [options.get("top_k", 0)] for p in prompts]


def test_prompts_options_and_whole_tails(spark):
    rows = spark.createDataFrame([("k", list(range(10, 16)))], "k string, a array<int>")
    out = models.generate_long(rows, "k", "a", Whole, 4, 0, (-1, -2, -3), prompt=([7], [8]), top_k=5).first().target
    first = [-1, 7, 10, 11, 12, 13, -2, -3, 8, 5]
    assert out == first + [-1, 14, 15, -2, -3] + first + [5]  # an overlap of 0 is the whole target
    ids = spark.createDataFrame([([1, 2],), (None,)], "p array<int>").select(models.generate(F.col("p"), Whole, 3, top_k=9).alias("o"))
    assert [r.o for r in ids.collect()] == [[1, 2, 9], None]

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from auralake.operators import models

STOP = 66644


class Whole:
    """Gives back its whole prompt, then a stop id and one more."""

    def generate(self, prompts, **options):
        return [p + [STOP, options.get("top_k", 0)] for p in prompts]


class Server:
    """Answers with one frame of a prompt's length, as numbers in text."""

    def complete(self, prompts, **options):
        assert options == {"temperature": 0.5}
        v = models.VOCABULARY
        return [" ".join(str(v.audio_offset + c * v.codebook_size + len(p)) for c in range(v.codebooks)) + f" {STOP} 1" for p in prompts]


class Numbers:
    def encode(self, text):
        return [int(x) for x in text.split()]


class Finer:
    def refine(self, books):
        return np.concatenate([books, books + 1])


def test_convert(spark):
    rows = spark.createDataFrame([([1, 2],), ([],), (None,)], "a array<int>")
    got = [r.o for r in rows.select(models.convert(F.col("a"), Whole, (-1, -2, -3), stop=STOP, top_k=7).alias("o")).collect()]
    assert got == [[-1, 1, 2, -2, -3], [-1, -2, -3], None]
    assert rows.select(models.convert(F.col("a"), Whole, (-1, -2, -3), top_k=7)).first()[0] == [-1, 1, 2, -2, -3, STOP, 7]


def test_completion_server(spark):
    rows = spark.createDataFrame([("hello", "[s]"), ("hello again", None)], "text string, speaker_id string")
    out = models.speak_by_server(rows, Server, Numbers, models.DoubleCodec, STOP, temperature=0.5).collect()
    for r in out:
        assert r.valid and r.books == [[len(r.prompt)]] * 8 and len(r.wave) == 1
    assert out[0].prompt.endswith("[s]") and out[1].prompt.endswith(models.VOCABULARY.unknown_speaker)
    none = spark.createDataFrame([(None,)], "p string").select(models.complete(F.col("p"), Server, temperature=0.5))
    assert none.first()[0] is None


def test_codec_round_trip(spark):
    rows = spark.createDataFrame([([0.0, 0.5, -0.5], 24_000), (None, 24_000)], "wave array<float>, rate int")
    plain, null = models.round_trip(rows, models.DoubleCodec).collect()
    assert np.abs(np.array(plain.again) - plain.wave).max() < 0.02 and null.books is None and null.again is None
    finer = models.round_trip(rows, models.DoubleCodec, Finer).first()
    assert len(finer.books) == 16 and finer.books[:8] == plain.books and finer.books[8] == [b + 1 for b in plain.books[0]]


def test_steps_in_sql(spark):
    names = models.register(spark, models.DoubleTokenizer, Whole, models.DoubleCodec, prefix="m_", most=3)
    assert names == ["m_encode_text", "m_decode_text", "m_generate_ids", "m_decode_books"]
    assert spark.sql("SELECT m_decode_text(m_encode_text(t)) FROM VALUES ('abc') AS x(t)").first()[0] == "abc"
    assert spark.sql("SELECT m_generate_ids(array(5)) FROM VALUES (1) AS x(t)").first()[0] == [5, STOP, 0]


def test_a_step_gives_on_what_it_made_of_a_part(spark):
    texts = pd.Series(["ab" * 2000, None, "", "c" * 3 * models.PART] + ["xyz" * 1000] * 3000)
    ids = list(models.text_encoder(models.DoubleTokenizer).func(iter([texts, texts[:0]])))
    assert max(sum(len(x) for x in s if x is not None) for s in ids) == 3 * models.PART and max(map(len, ids)) < 300
    want = [None if t is None else [ord(c) for c in t] for t in texts]
    assert [x for s in ids for x in s] == want
    whole = pd.Series([None if x is None else np.array(x) for x in want])
    again = list(models.text_decoder(models.DoubleTokenizer).func(iter([whole])))
    assert max(map(len, again)) < 300 and [x for s in again for x in s] == list(texts)
    for found in (models.generator(Whole).func(iter([whole])), models.books_decoder(models.DoubleCodec).func(iter([pd.Series([[np.zeros(3000)] * 8] * 1000)]))):
        assert max(map(len, found)) < 500


def test_a_step_over_large_batches(spark):
    rows = spark.range(0, 9000, 1, 1).select("id", F.expr("repeat(cast(id as string), 100)").alias("t"))
    again = models.decode_text(models.encode_text(F.col("t"), models.DoubleTokenizer), models.DoubleTokenizer)
    assert rows.select("t", again.alias("u")).where("t = u").count() == 9000
    made = rows.select("id", models.generate(F.when(F.col("id") % 2 == 0, F.array(F.col("id").cast("int"))), Whole).alias("o"))
    assert made.where("IF(id % 2 = 0, o[0] = id AND size(o) = 3, o IS NULL)").count() == 9000

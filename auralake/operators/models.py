"""Where models plug in: typed steps around the native algebra. No weights are shipped.

A step is made once per Python worker and sees Arrow batches, part by part: what it makes of a part is given on before
the next is begun, so a worker holds one batch of input and the results of a part, however many rows there are. The
doubles at the end are stand-ins for tests of the plumbing; they generate nothing like speech and are no evidence about any model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.config import VOCABULARY, Vocabulary, ship
from auralake.functions import arrays, tokens
from auralake.functions.text import sanitize

IDS = T.ArrayType(T.IntegerType())
WAVE = T.ArrayType(T.FloatType())
#: Characters, ids or samples that a step is given at once, in whole rows, and what a row counts besides for what may be made of it.
PART, ROW = 1 << 20, 1 << 10


class TextTokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class AudioCodec(Protocol):
    def encode(self, wave: np.ndarray, rate: int) -> np.ndarray: ...  # [book][frame]

    def decode(self, books: np.ndarray) -> np.ndarray: ...  # samples


class Generator(Protocol):
    def generate(self, prompts: list[list[int]], **options: object) -> list[list[int]]: ...  # temperature, top_k, do_sample


class Completer(Protocol):
    """A client of a server that tokenises by itself."""

    def complete(self, prompts: list[str], **options: object) -> list[str]: ...  # temperature, max_tokens


class Refiner(Protocol):
    """A codec that fills in the finer books of a coarse code by itself."""

    def refine(self, books: np.ndarray) -> np.ndarray: ...  # [book][frame], with more books


_made: dict[bytes, object] = {}


def once(make: Callable[[], object]) -> object:
    """The worker's instance of what make builds: factories that differ in anything they carry have instances of their own."""
    key = cloudpickle.dumps(make)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _step(kind: T.DataType | str) -> Callable:
    """A pandas_udf whose workers have this package."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    return F.pandas_udf(kind)


def _size(x: object) -> int:
    """Characters of a text, or elements of an array or of a matrix's rows."""
    if x is None:
        return 0
    return sum(map(len, x)) if len(x) and isinstance(x[0], (list, np.ndarray)) else len(x)


def _parts(s: pd.Series, row: int = ROW) -> Iterator[slice]:
    """Runs of whole rows that together count at most PART; a row that counts more is a run of its own."""
    start = held = 0
    for i, x in enumerate(s):
        n = _size(x) + row
        if i > start and held + n > PART:
            yield slice(start, i)
            start, held = i, 0
        held += n
    yield slice(start, len(s))


def text_encoder(make: Callable[[], TextTokenizer]) -> Callable[..., Column]:
    @_step(IDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = once(make)
        for s in batches:
            for p in _parts(s):
                yield s.iloc[p].map(lambda x: None if x is None else t.encode(x))

    return run


def encode_text(text: Column, make: Callable[[], TextTokenizer]) -> Column:
    return text_encoder(make)(text)


def text_decoder(make: Callable[[], TextTokenizer]) -> Callable[..., Column]:
    @_step(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = once(make)
        for s in batches:
            for p in _parts(s):
                yield s.iloc[p].map(lambda x: None if x is None else t.decode([int(i) for i in x]))

    return run


def decode_text(ids: Column, make: Callable[[], TextTokenizer]) -> Column:
    return text_decoder(make)(ids)


def encode_books(wave: Column, rate: Column, make: Callable[[], AudioCodec]) -> Column:
    """The codec's books [book][frame] of a waveform."""

    @_step(T.ArrayType(IDS))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        codec = once(make)
        for waves, rates in batches:
            for p in _parts(waves):
                yield pd.Series([None if w is None else [list(map(int, b)) for b in codec.encode(np.asarray(w), int(r))] for w, r in zip(waves.iloc[p], rates.iloc[p], strict=True)])

    return run(wave, rate)


def with_audio_ids(rows: DataFrame, make: Callable[[], AudioCodec], wave: str = "wave", rate: str = "rate", name: str = "audio_ids", v: Vocabulary = VOCABULARY) -> DataFrame:
    """rows with the flat audio ids of their waveforms: the codec's books, interleaved."""
    stored = _stored(rows, "__books", encode_books(F.col(wave), F.col(rate), make))
    return stored.withColumn(name, tokens.encode_audio(F.col("__books"), v)).drop("__books")


def books_decoder(make: Callable[[], AudioCodec]) -> Callable[..., Column]:
    @_step(WAVE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = once(make)
        for s in batches:
            for p in _parts(s):
                yield s.iloc[p].map(lambda m: None if m is None else codec.decode(np.array([np.asarray(b) for b in m])).astype(np.float32))

    return run


def decode_books(books: Column, make: Callable[[], AudioCodec]) -> Column:
    return books_decoder(make)(books)


def refine_books(books: Column, make: Callable[[], Refiner]) -> Column:
    """The codec's own finer books of coarse ones."""

    @_step(T.ArrayType(IDS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = once(make)
        for s in batches:
            for p in _parts(s):
                yield pd.Series([None if m is None else [list(map(int, b)) for b in codec.refine(np.array([np.asarray(b) for b in m]))] for m in s.iloc[p]])

    return run(books)


def round_trip(rows: DataFrame, make: Callable[[], AudioCodec], refine: Callable[[], Refiner] | None = None, wave: str = "wave", rate: str = "rate") -> DataFrame:
    """rows with the books of their waveforms, refined if a refiner is given, and the waveform these give (again)."""
    books = encode_books(F.col(wave), F.col(rate), make)
    out = rows.withColumn("books", refine_books(books, refine) if refine else books)
    return out.withColumn("again", decode_books(F.col("books"), make))


def generator(make: Callable[[], Generator], most: int = 1024, **options: object) -> Callable[..., Column]:
    @_step(IDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(make)
        for batch in batches:
            for part in _parts(batch, most):
                s = batch.iloc[part]
                asked = [[int(i) for i in p] for p in s if p is not None]
                out = iter(model.generate(asked, **options) if asked else [])
                yield pd.Series([None if p is None else next(out)[:most] for p in s])

    return run


def generate(prompt: Column, make: Callable[[], Generator], most: int = 1024, **options: object) -> Column:
    """At most `most` generated ids for each prompt, a part of a batch at a time; options reach the model as they are."""
    return generator(make, most, **options)(prompt)


def convert(source: Column, make: Callable[[], Generator], marks: tuple[int, int, int], most: int = 1024, stop: int | None = None, **options: object) -> Column:
    """What a model makes of a whole source at once: ids of one kind to ids of another, up to the stop id.

    marks are the ids of the source's kind, of the conversion and of the target's kind. Sources that
    exceed a model's context are for generate_long.
    """
    first, turn, last = (F.lit(m) for m in marks)
    found = generate(F.concat(F.array(first), source, F.array(turn, last)), make, most, **options)
    return found if stop is None else tokens.until_stop(found, stop)


def complete(prompt: Column, make: Callable[[], Completer], **options: object) -> Column:
    """What a completion server answers to each prompt; each worker has one client, and null prompts none."""

    @_step(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = once(make)
        for batch in batches:
            for part in _parts(batch):
                s = batch.iloc[part]
                asked = [p for p in s if p is not None]
                out = iter(client.complete(asked, **options) if asked else [])
                yield pd.Series([None if p is None else next(out) for p in s], dtype=object)

    return run(prompt)


def speak_by_server(requests: DataFrame, client: Callable[[], Completer], tokenizer: Callable[[], TextTokenizer], codec: Callable[[], AudioCodec], stop: int, v: Vocabulary = VOCABULARY, **options: object) -> DataFrame:
    """Text requests (text, speaker_id) to waveforms by a server of text: prompt, answer, ids, books, valid, wave."""
    speaker = F.coalesce("speaker_id", F.lit(v.unknown_speaker))
    out = requests.withColumn("prompt", tokens.tts_prompt_text(sanitize(F.col("text")), speaker, v))
    out = out.withColumn("answer", complete(F.col("prompt"), client, **options)).withColumn("ids", encode_text(F.col("answer"), tokenizer))
    out = _stored(out, "books", tokens.decode_audio(tokens.until_stop(F.col("ids"), stop), v))
    return out.withColumn("valid", tokens.non_negative(F.col("books"))).withColumn("wave", decode_books(F.col("books"), codec))


def register(spark: SparkSession, tokenizer: Callable[[], TextTokenizer], model: Callable[[], Generator], codec: Callable[[], AudioCodec], prefix: str = "", most: int = 1024, **options: object) -> list[str]:
    """The steps as functions of SQL: encode_text, decode_text, generate_ids and decode_books, with a prefix; their names."""
    steps = {"encode_text": text_encoder(tokenizer), "decode_text": text_decoder(tokenizer), "generate_ids": generator(model, most, **options), "decode_books": books_decoder(codec)}
    for name, step in steps.items():
        spark.udf.register(prefix + name, step)
    return [prefix + name for name in steps]


def _stored(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that the optimiser does not move into its uses: a Python step cannot take a lambda as its argument."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def speak(requests: DataFrame, tokenizer: Callable[[], TextTokenizer], model: Callable[[], Generator], codec: Callable[[], AudioCodec], marks: dict[str, int], v: Vocabulary = VOCABULARY, audio: str | None = None, most: int = 1024, **options: object) -> DataFrame:
    """Text requests (text, speaker_id) to waveforms: prompt, ids, books, valid, wave.

    All but the three model steps stays in the JVM. A column of audio ids is continued if given; options
    (temperature, top_k, do_sample) reach the model.
    """
    prompt = tokens.tts_prompt(F.col("__text"), F.col("__speaker"), *(F.lit(marks[m]) for m in (v.text, v.convert, v.audio)))
    out = requests.withColumn("__text", encode_text(sanitize(F.col("text")), tokenizer)).withColumn("__speaker", encode_text(F.coalesce("speaker_id", F.lit(v.unknown_speaker)), tokenizer))
    out = out.withColumn("prompt", tokens.with_audio_context(prompt, F.col(audio), v=v) if audio else prompt).drop("__text", "__speaker")
    out = out.withColumn("ids", generate(F.col("prompt"), model, most, **options))
    out = _stored(out, "books", tokens.decode_audio(tokens.until_stop(F.col("ids"), marks[v.stop]), v))
    out = out.withColumn("valid", tokens.non_negative(F.col("books")))
    return out.withColumn("wave", decode_books(F.col("books"), codec))


def continue_audio(requests: DataFrame, model: Callable[[], Generator], codec: Callable[[], AudioCodec], marks: dict[str, int], v: Vocabulary = VOCABULARY, most: int = 1024, **options: object) -> DataFrame:
    """Waveforms (wave, rate) and what a model makes follow them; options (temperature, top_k, do_sample) reach the model."""
    heard = with_audio_ids(requests, codec, v=v)
    out = _stored(heard, "prompt", tokens.continuation_prompt(F.col("audio_ids"), F.lit(marks[v.audio]))).drop("audio_ids", "wave")
    out = out.withColumn("ids", generate(F.col("prompt"), model, most, **options))
    out = _stored(out, "books", tokens.decode_audio(tokens.until_stop(F.col("ids"), marks[v.stop]), v))
    return out.withColumn("valid", tokens.non_negative(F.col("books"))).withColumn("wave", decode_books(F.col("books"), codec))


def long_prompt(part: list[int], first: bool, context: list[int], marks: tuple[int, int, int], prompt: tuple[list[int], list[int]]) -> list[int]:
    """What a model is asked for one chunk of a long source: the first has the prompt around it, others what was given last."""
    before, after = (prompt[0], prompt[1]) if first else ([], context)
    return [marks[0], *before, *part, marks[1], marks[2], *after]


def tail_length(new: int, part: int, first: bool, overlap: int) -> int:
    """How many of the ids given so far belong to the overlap with the next chunk, rounded up to an even number."""
    n = -(-overlap * new // max(1, part - (0 if first else overlap)))
    return n + n % 2


def generate_long(rows: DataFrame, key: str, source: str, make: Callable[[], Generator], most: int, overlap: int, marks: tuple[int, int, int], limit: int = 1024, prompt: tuple[list[int], list[int]] = ([], []), **options: object) -> DataFrame:
    """Chunk after chunk of one long source, each prompted by the tail of what the last one gave.

    Chunks of a key follow one another; keys run side by side. A prompt's source stands before the first
    chunk and its target after it. A tail of no ids is all that was given so far, as a slice from -0 is.
    """
    ship(rows.sparkSession)
    out = T.StructType([rows.schema[key], T.StructField("target", IDS)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, got = once(make), []
        for k, a in zip(pdf[key], pdf[source], strict=True):
            a, target, context, at = [int(x) for x in a], [], [], 0
            while at < len(a):
                part = a[at : at + most]
                new = model.generate([long_prompt(part, not at, context, marks, prompt)], **options)[0][:limit]
                target += new
                context = target[-tail_length(len(new), len(part), not at, overlap) :]
                if at + most > len(a):
                    break
                at += most - overlap
            got.append((k, target))
        return pd.DataFrame(got, columns=[key, "target"])

    return rows.groupBy(key).applyInPandas(run, out)


class DoubleTokenizer:
    """A stand-in: code points as ids."""

    def encode(self, text: str) -> list[int]:
        return [ord(c) for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


class DoubleCodec:
    """A stand-in: 8-bit samples as codes of all books alike."""

    def encode(self, wave: np.ndarray, rate: int) -> np.ndarray:
        return np.tile(np.clip((wave + 1) * 127, 0, 254).astype(int), (VOCABULARY.codebooks, 1))

    def decode(self, books: np.ndarray) -> np.ndarray:
        return books[0] / 127 - 1 if books.size else np.zeros(0)


class DoubleGenerator:
    """A stand-in: as many frames as the prompt has ids, then the stop id."""

    def __init__(self, stop: int, v: Vocabulary = VOCABULARY):
        self.stop, self.v = stop, v

    def generate(self, prompts: list[list[int]], **options: object) -> list[list[int]]:
        v = self.v
        return [[v.audio_offset + c * v.codebook_size + i % v.codebook_size for i in p for c in range(v.codebooks)] + [self.stop] for p in prompts]


def time_crop(wave: Column, rate: int, seconds: int = 5) -> Column:
    return arrays.crop_seconds(wave, rate, seconds)

"""Token and codebook algebra on array columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auralake.config import VOCABULARY, Vocabulary
from auralake.functions.arrays import drop, drop_last, indices, let, take


def interleave(books: Column, size: int, offset: int = 0, count: int | None = None) -> Column:
    """Ids of a matrix [book][frame], frame by frame: book * size + code + offset."""

    def of(m: Column) -> Column:
        n = F.lit(count) if count else F.size(m)
        frames = F.size(F.get(m, 0))
        return F.flatten(F.transform(indices(frames), lambda t: F.transform(indices(n), lambda c: F.get(F.get(m, c), t) + c * size + offset)))

    return let(books, of)


def deinterleave(ids: Column, count: int, size: int, offset: int = 0) -> Column:
    """The matrix [book][frame] of interleaved ids; an incomplete last frame is left out."""

    def of(a: Column) -> Column:
        frames = F.floor(F.size(a) / count).cast("int")
        return F.transform(F.array(*map(F.lit, range(count))), lambda c: F.transform(indices(frames), lambda t: F.get(a, t * count + c) - offset - c * size))

    return let(ids, of)


def encode_audio(books: Column, v: Vocabulary = VOCABULARY) -> Column:
    return interleave(books, v.codebook_size, v.audio_offset, v.codebooks)


def decode_audio(ids: Column, v: Vocabulary = VOCABULARY) -> Column:
    return deinterleave(ids, v.codebooks, v.codebook_size, v.audio_offset)


def shift(a: Column, by: int) -> Column:
    return F.transform(a, lambda x: x + by)


def until_stop(a: Column, stop: int | Column) -> Column:
    """What comes before the first stop id; all of it if there is none."""
    stop = F.lit(stop) if isinstance(stop, int) else stop
    at = F.array_position(a, stop).cast("int")
    return F.when(at > 0, take(a, at - 1)).otherwise(a)


def without_prompt(generated: Column, prompt: Column) -> Column:
    return drop(generated, F.size(prompt))


def tts_prompt(text: Column, speaker: Column, text_mark: Column, convert: Column, audio_mark: Column) -> Column:
    """[text] text [convert] [audio] speaker, as ids."""
    return F.concat(F.array(text_mark), text, F.array(convert, audio_mark), speaker)


def tts_prompt_text(text: Column, speaker: Column, v: Vocabulary = VOCABULARY) -> Column:
    """The same prompt as a string, for servers that tokenise themselves."""
    return F.concat(F.lit(v.text), text, F.lit(v.convert + v.audio), speaker)


def asr_prompt(audio: Column, audio_mark: Column, convert: Column, text_mark: Column) -> Column:
    return F.concat(F.array(audio_mark), audio, F.array(convert, text_mark))


def continuation_prompt(audio: Column, audio_mark: Column) -> Column:
    return F.concat(F.array(audio_mark), audio)


def staged_prompt(source: Column, source_mark: Column, convert: Column, target_mark: Column) -> Column:
    """[source] ids [convert] [target]: text to semantic, semantic to acoustic and back."""
    return F.concat(F.array(source_mark), source, F.array(convert, target_mark))


def with_audio_context(prompt: Column, audio: Column, frames: int = 2, v: Vocabulary = VOCABULARY) -> Column:
    """The prompt and the audio without its last frames, which the model is to continue."""
    return F.concat(prompt, drop_last(audio, frames * v.codebooks))


def collapse_runs(a: Column) -> Column:
    """One element of each run of equal neighbours; an empty array stays empty."""
    return let(a, lambda x: F.filter(x, lambda v, i: (i == 0) | (v != F.get(x, i - 1))))


def interleave_two(books: Column, size: int = 1024) -> Column:
    """The first two rows, the second shifted by size, element by element."""
    return let(books, lambda m: F.flatten(F.zip_with(F.get(m, 0), F.get(m, 1), lambda a, b: F.array(a, b + size))))


def first_two(books: Column) -> Column:
    return F.slice(books, 1, 2)


def violations(ids: Column, size: int = 1024) -> Column:
    """Places of interleaved two-book ids that lie in the other book's range."""
    return let(ids, lambda a: F.filter(indices(F.size(a)), lambda i: F.when(i % 2 == 0, F.get(a, i) >= size).otherwise(F.get(a, i) < size)))


def all_codes_valid(books: Column, v: Vocabulary = VOCABULARY) -> Column:
    """No code below 0 or beyond its codebook."""
    return F.forall(books, lambda row: F.forall(row, lambda x: (x >= 0) & (x < v.codebook_size)))


def non_negative(books: Column) -> Column:
    return F.forall(books, lambda row: F.forall(row, lambda x: x >= 0))


def join_books(first: Column, second: Column) -> Column:
    """Two matrices of as many rows, joined along time."""
    return F.zip_with(first, second, lambda a, b: F.concat(a, b))


def proportional(lengths: Column, factor: int) -> Column:
    return F.transform(lengths, lambda s: s * factor)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def narrow(books: Column) -> Column:
    """Codes as small integers; a code that does not fit raises under ANSI rules."""
    return books.cast("array<array<smallint>>")


def widen(a: Column) -> Column:
    return a.cast("array<bigint>")

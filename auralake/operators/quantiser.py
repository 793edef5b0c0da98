"""A residual vector quantiser: codebooks that each code what those before leave over.

A vector's code in the first book is the nearest codeword, that in the second the one nearest to the rest, and so
on; the sum of the codewords is what the code stands for, and each book makes the error of the vectors it was fitted on
smaller, or keeps it. Books are fitted one after another by Lloyd's rounds: tasks give their vectors to the nearest
codewords and add up what each has got, the sums are added by an aggregate, and the means are the new codewords. What a round
sends is a row for each task and codeword, and what the driver holds is the books, `size` codewords of the vectors' length. Nothing
of a vector is collected but the first codewords, chosen by a hash.

Null vectors and those that hold nulls or are of another length than the books have no code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.config import ship

#: Vectors whose distances to a book are held at once.
AT_ONCE = 2048


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest codeword of each vector, the first of several."""
    out = np.empty(len(x), np.int64)
    square = (book * book).sum(1)
    for i in range(0, len(x), AT_ONCE):
        out[i : i + AT_ONCE] = (square - 2 * (x[i : i + AT_ONCE] @ book.T)).argmin(1)
    return out


def codes_of(x: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """[book][vector]: the codes of vectors, book by book on what is left over."""
    rest, out = x.astype(np.float64), np.empty((len(books), len(x)), np.int64)
    for b, book in enumerate(books):
        out[b] = nearest(rest, book)
        rest = rest - book[out[b]]
    return out


def finer(x: np.ndarray, coarse: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """[book][vector]: coarse codes, and those of the later books for what the coarse ones leave over of the vectors."""
    rest = x - vectors_of(coarse, books) if len(coarse) else x
    return np.concatenate([coarse, codes_of(rest, books[len(coarse) :])])


def vectors_of(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes [book][vector] stand for; of fewer books than there are, the coarse ones."""
    return sum((book[c] for c, book in zip(codes, books, strict=False)), np.zeros((codes.shape[1], books[0].shape[1])))


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    return rows.select(F.col(vector).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are of that length, and these as rows."""
    sizes = np.diff(column.offsets.to_numpy())
    own = np.flatnonzero(sizes == length)
    values = column.values.to_numpy(zero_copy_only=False)
    return own, values[column.offsets.to_numpy()[own][:, None] + np.arange(length)]


def fit(rows: DataFrame, vector: str, stages: int = 8, size: int = 256, rounds: int = 10, seed: int = 0) -> list[np.ndarray]:
    """`stages` books of at most `size` codewords; as many as there are different vectors to begin with, if these are fewer."""
    spark = rows.sparkSession
    ship(spark)
    own = _usable(rows, vector)
    # The length that most vectors have.
    lengths = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return []
    own = own.where(F.size("x") == lengths.d)
    first = own.select("x", F.xxhash64("x", F.lit(seed)).alias("h")).groupBy("h").agg(F.first("x").alias("x")).orderBy("h").limit(size).collect()
    start = np.array([r.x for r in first])
    books: list[np.ndarray] = []
    for _ in range(stages):
        # The first codewords of a later book are what the earlier ones leave over of the same vectors.
        book = start - vectors_of(codes_of(start, books), books) if books else start
        for _ in range(rounds):
            new = _round(own, [*books, book], lengths.d)
            if np.array_equal(new, book):
                break
            book = new
        books.append(book)
    return books


def _round(own: DataFrame, books: list[np.ndarray], d: int) -> np.ndarray:
    """The last book with each codeword moved to the mean of what is nearest to it; one that nothing is nearest to stays."""
    held = own.sparkSession.sparkContext.broadcast(books)  # size * d numbers a book

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *before, book = held.value
        n, sums = np.zeros(len(book), np.int64), np.zeros(book.shape)
        for batch in batches:
            _, x = _matrix(batch.column("x"), d)
            if before:
                x = x - vectors_of(codes_of(x, before), before)
            code = nearest(x, book)
            n += np.bincount(code, minlength=len(book))
            np.add.at(sums, code, x)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["code", "n", "sums"])

    parts = own.mapInArrow(added, "code long, n long, sums array<double>")
    whole = parts.groupBy("code").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(d)))
    book = books[-1].copy()
    for r in whole.collect():
        book[r[0]] = np.array(r[2:]) / r[1]
    held.unpersist()
    return book


def encode(rows: DataFrame, vector: str, books: list[np.ndarray], name: str = "codes", coarse: str | None = None) -> DataFrame:
    """rows with the codes of their vectors, one a book; null where a vector has none.

    coarse: a column with the codes of the first books, which stay; only the later books are searched. A row that has none
    there is coded from the start.
    """
    ship(rows.sparkSession)
    held, d = rows.sparkSession.sparkContext.broadcast(books), books[0].shape[1]
    mark = "_" * (1 + max(map(len, rows.columns)))
    x = F.when(F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))), F.col(vector).cast("array<double>"))
    wide = rows.select("*", F.coalesce(x, F.array().cast("array<double>")).alias(mark))
    kept = rows.columns

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, m = _matrix(batch.column(mark), d)
            out: list = [None] * batch.num_rows
            before = batch.column(coarse).to_pylist() if coarse else [None] * batch.num_rows
            # Vectors with as many coarse codes go together.
            groups: dict[int, list[int]] = {}
            for place, i in enumerate(own):
                groups.setdefault(len(before[i] or ()), []).append(place)
            for n, places in groups.items():
                first = np.array([before[own[p]] or [] for p in places], np.int64).reshape(len(places), n).T
                for p, c in zip(places, finer(m[places], first, held.value).T, strict=True):
                    out[own[p]] = c.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.list_(pa.int32()))], names=[*kept, name])

    return wide.mapInArrow(coded, type(rows.schema)(list(rows.schema.fields)).add(name, T.ArrayType(T.IntegerType())))


def decode(codes: Column, books: list[np.ndarray], stages: int | None = None) -> Column:
    """The vector that the first `stages` codes stand for, in the JVM; null without codes. For books of few numbers: they are part of the plan."""
    some = books[:stages]
    words = F.array(*(F.array(*(F.array(*(F.lit(float(v)) for v in word)) for word in book)) for book in some))
    parts = F.transform(F.slice(codes, 1, len(some)), lambda c, b: F.get(F.get(words, b), c))
    zero = F.array(*(F.lit(0.0) for _ in range(books[0].shape[1])))
    return F.when(codes.isNotNull(), F.aggregate(parts, zero, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b)))


class ResidualCodec:
    """A codec of the model steps: frames of a waveform as vectors, books of codes for them, and back."""

    def __init__(self, books: list[np.ndarray]):
        self.books, self.frame = books, books[0].shape[1]

    def encode(self, wave: np.ndarray, rate: int) -> np.ndarray:
        """[book][frame]; the last frame is filled up with silence."""
        n = -(-len(wave) // self.frame)
        x = np.zeros(n * self.frame)
        x[: len(wave)] = wave
        return codes_of(x.reshape(n, self.frame), self.books)

    def decode(self, books: np.ndarray) -> np.ndarray:
        return vectors_of(np.asarray(books), self.books).ravel() if np.size(books) else np.zeros(0)


def codec(books: list[np.ndarray]) -> Callable[[], ResidualCodec]:
    """A factory for the model steps; it carries the books."""
    return lambda: ResidualCodec(books)


def frames(rows: DataFrame, wave: str, frame: int) -> DataFrame:
    """rows of `frame` samples each, as `x`, of waveforms; what is left at an end is filled up with silence."""
    w, n = F.col(wave).cast("array<double>"), F.ceil(F.size(wave) / frame).cast("int")
    at = F.explode(F.sequence(F.lit(0), n - 1))
    cut = rows.where(F.size(wave) > 0).select(w.alias("w"), at.alias("at")).select(F.slice("w", F.col("at") * frame + 1, F.lit(frame)).alias("x"))
    return cut.select(F.concat("x", F.array_repeat(F.lit(0.0), F.lit(frame) - F.size("x"))).alias("x"))

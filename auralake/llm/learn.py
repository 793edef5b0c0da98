"""What the classifiers share: a bounded sample of labelled rows, sparse features of whole texts, calibration.

Only the sample's hashed features come to the driver: one row an id, and no more than BYTES of features in
all, counted before they are collected. Scoring reads every text whole and in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.config import ship
from auralake.llm.common import chunks, columns_text, cut

#: features(bytes, offsets) gives the buckets of all texts, and the bounds by text.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


#: Bytes of features that come to the driver, at most, and slots that ids are dealt to for that count.
BYTES, SLOTS = 1 << 28, 4096


def share(rows: DataFrame, n: int, bound: int, key: str, seed: int) -> DataFrame:
    """About `bound` of n rows, the same ones on any run: those whose hashed key is low enough."""
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) < int(bound / n * (1 << 40)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """key, text and y (0 or 1) of about `bound` labelled rows for which train holds; conflicting labels count as 1.

    The labels are thinned before the join, so the side that is joined has about `bound` rows.
    """
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & train).groupBy(F.col(id).alias("__id")).agg(F.max(label).cast("int").alias("y"))
    known = cut(known)
    some = share(known, known.count(), bound, "__id", seed)
    return docs.select(F.col(id).alias("__key"), F.col(text).alias("text")).join(F.broadcast(some), F.col("__key") == F.col("__id")).select(F.col("__key").alias("key"), "text", "y")


def collect(rows: DataFrame, target: str, kind: T.DataType, features: Features, counts: bool = False, most: int = BYTES) -> tuple[list[np.ndarray], list[np.ndarray], list]:
    """Buckets, their counts and the target of each row (key, text, target); rows without features are left out.

    Of rows that share a key the one whose features have the least hash counts. Keys are taken in the order of a hash
    while their features fit `most` bytes. They come in the order of their content, so that reruns train on the
    same sequence.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in chunks(columns_text(batch, "text")):
                out: tuple[list, list, list, list] = ([], [], [], [])
                buckets, at = features(data, offs)
                for k in range(j - i):
                    own, n = np.unique(buckets[at[k] : at[k + 1]], return_counts=True)
                    if len(own):
                        out[0].append(batch.column("key")[i + k].as_py())
                        out[1].append(own.astype("<i4").tobytes())
                        out[2].append(n.astype("<i4").tobytes() if counts else b"")
                        out[3].append(batch.column(target)[i + k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), pa.array(out[3], batch.column(target).type)], names=["key", "f", "n", "y"])

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("f", T.BinaryType()), T.StructField("n", T.BinaryType()), T.StructField("y", kind)])
    made = rows.select(F.col("key").cast("string").alias("key"), "text", target).mapInArrow(found, schema)
    one = made.groupBy("key").agg(F.min(F.struct(F.xxhash64("f", "n").alias("h"), "f", "n", "y")).alias("r"))
    one = cut(one.select("r.*", F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot")))
    sizes = sorted(one.groupBy("slot").agg(F.sum(F.octet_length("f") + F.octet_length("n")).alias("bytes")).collect())
    total, until = 0, SLOTS
    for r in sizes:
        total += r.bytes
        if total > most:
            until = r.slot
            break
    got = one.where(F.col("slot") < until).select("f", "n", "y").toArrow()
    f, n, y = (got.column(c).to_pylist() for c in ("f", "n", "y"))
    order = sorted(range(len(f)), key=lambda i: (hash_bytes(f[i]), str(y[i])))
    return [np.frombuffer(f[i], "<i4") for i in order], [np.frombuffer(n[i], "<i4") for i in order], [y[i] for i in order]


def hash_bytes(b: bytes) -> bytes:
    import hashlib

    return hashlib.md5(b).digest()


def score(docs: DataFrame, keep: list[Column], text: str, schema: str, scorer: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """keep, and the columns that scorer(bytes, offsets) gives for each chunk of whole texts."""
    ship(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kept = [f for f in rows.schema.fields if f.name != "__text"]
    made = T.StructType.fromDDL(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scorer(data, offs) for _, _, data, offs in chunks(columns_text(batch, "__text"))]
            if not parts:
                continue
            columns = [pa.concat_arrays([p[c] for p in parts]) for c in range(len(parts[0]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *made.names])

    return rows.mapInArrow(scored, T.StructType([*kept, *made.fields]))


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))) by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def held_out(id: str, folds: int, fold: int) -> Column:
    """Whether crc32(id as text) mod folds is fold; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds)) == fold, F.lit(False))

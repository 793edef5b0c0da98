"""Quality by naive Bayes support vectors: n-gram indicators scaled by log-count ratios, and a linear hinge loss.

n-grams are runs of three bytes of the text as it stands (case and marks tell noise from prose) and
one more of words: whether a word follows itself. An indicator's value is r = log of the ratio of its
smoothed shares in the two classes; a text's vector has unit length per root of its indicators. The
linear model is fitted by dual coordinate descent on a bounded sample of labelled rows (SAMPLE), then
calibrated on a fifth of it.

A null or empty text has no indicators and gets the calibrated bias. Without labelled rows, or with
labels of one kind only, every score is the smoothed share of label 1. Texts are read whole, however long;
an empty table gives no rows. Repeated rows get equal scores;
extra columns of docs are dropped, those of labels are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm import learn
from auralake.llm.common import table
from auralake.llm.wordhash import fold, span_hashes, word_spans

#: Labelled rows that are fitted on, at most about.
SAMPLE = 8000
BITS = 16
TWICE = 1 << BITS


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text (with repeats), and their bounds."""
    b = data.astype(np.uint32)
    n = len(b)
    at = np.maximum(offs[1:] - offs[:-1] - 2, 0)
    code = np.zeros(0, np.int64)
    if n >= 3:
        whole = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        inside = np.ones(n - 2, bool)
        for back in (1, 2):  # runs that reach into the next text
            edge = offs[1:-1] - back
            inside[edge[(edge >= 0) & (edge < n - 2)]] = False
        code = whole[inside].astype(np.int64)
    low = fold(data)
    starts, ends, bounds = word_spans(low, offs)
    words = span_hashes(low, starts, ends)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][bounds[:-1] < len(words)]] = False
    twice = np.add.reduceat(np.append(again, False).astype(np.int64), bounds[:-1]) * (bounds[1:] > bounds[:-1]) > 0 if len(words) else np.zeros(len(at), bool)
    bounds3 = np.concatenate([[0], np.cumsum(at)])
    code = np.insert(code, bounds3[1:][twice], TWICE)
    return code, np.concatenate([[0], np.cumsum(at + twice)])


class Model:
    """r * w for each bucket, the bias and the calibration."""

    def __init__(self, rw: np.ndarray, bias: float, a: float, b: float):
        self.rw, self.bias, self.a, self.b = rw, bias, a, b

    def margin(self, own: np.ndarray) -> float:
        return self.bias + (float(self.rw[own].sum()) / np.sqrt(len(own)) if len(own) else 0.0)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        buckets, at = grams(data, offs)
        seen, out = np.zeros(TWICE + 1, bool), np.zeros(len(offs) - 1)
        for k in range(len(out)):
            own = buckets[at[k] : at[k + 1]]
            if len(own) < 512:
                own = np.unique(own)
            else:
                seen[own] = True
                own = np.flatnonzero(seen)
                seen[own] = False
            out[k] = self.margin(own)
        return learn.sigmoid(self.a * out + self.b)


def dual_descent(rows: list[np.ndarray], x: list[np.ndarray], sign: np.ndarray, upper: np.ndarray, size: int, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """alpha, weights and bias that minimise (w.w + bias^2) / 2 and upper * hinge loss of each row.

    A row has the values x at the places rows; one coordinate of the dual is set to its best at a time.
    """
    square = [float(v @ v) + 1.0 for v in x]
    alpha, w, bias = np.zeros(len(rows)), np.zeros(size), 0.0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            g = sign[k] * (w[rows[k]] @ x[k] + bias) - 1
            new = min(max(alpha[k] - g / square[k], 0.0), upper[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * sign[k]
                alpha[k] = new
                w[rows[k]] += step * x[k]
                bias += step
    return alpha, w, bias


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The log of each bucket's smoothed share in the rows of label 1, less that in the others."""
    sums = np.ones((2, TWICE + 1))
    for r, v in zip(rows, y, strict=True):
        sums[int(v)][r] += 1
    return np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 12, mix: float = 0.9, seed: int = 3) -> Model:
    """Dual coordinate descent on the hinge loss, with classes weighted to equal shares."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(np.zeros(TWICE + 1), 0.0, 0.0, float(np.log(p / (1 - p))))
    aside = np.arange(len(y)) % 5 == 0
    use = np.flatnonzero(~aside) if len(set(y[~aside])) > 1 else np.arange(len(y))
    own, label = [rows[k] for k in use], y[use]
    r = ratios(own, label)
    upper = c * np.where(label > 0, 0.5 / (label > 0).mean(), 0.5 / (label <= 0).mean())
    x = [r[k] / np.sqrt(len(k)) for k in own]
    _, w, bias = dual_descent(own, x, np.where(label > 0, 1.0, -1.0), upper, TWICE + 1, epochs, np.random.default_rng(seed))
    w = (1 - mix) * np.abs(w).mean() + mix * w
    m = Model(r * w, bias, 1.0, 0.0)
    held = np.flatnonzero(aside) if len(set(y[aside])) > 1 else use
    m.a, m.b = learn.platt(np.array([m.margin(rows[k]) for k in held]), y[held])
    return m


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "quality", keep: list[Column] | None = None, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """keep (the id), score and predicted for every row of docs."""
    rows = learn.labelled(docs, labels, label, train, sample, id, text)
    found, _, y = learn.collect(rows, "y", T.IntegerType(), grams)
    model = docs.sparkSession.sparkContext.broadcast(fit(found, np.array(y, float)))  # 2**BITS numbers
    return learn.score(docs, keep or [F.col(id)], text, "score double", lambda data, offs: [pa.array(model.value.scores(data, offs))]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", **how) -> DataFrame:
    """The rows of docs that are predicted good, as they are; rows travel as one struct, so any column names do."""
    scored = score_quality(docs, labels, train, text=text, keep=[F.struct("*").alias("__row")], **how)
    return scored.where(F.col("predicted") == 1).select("__row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learn.held_out("doc_id", 4, 2)
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out, keep=[F.col("doc_id"), out.alias("held_out")])


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}

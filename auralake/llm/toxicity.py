"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their prefixes of 4 to 7 bytes, so that members of a word family
share terms. A term of the sample counts for more the further its log-odds stand from none, in standard
errors: its value is that to the power of POWER, at least 1, and a text's values have unit length. No term
of at least `mindf` rows of the sample is left out, so a pair of terms that are neutral by themselves, each
as frequent in either class, can still be learned. Labels of the rows set aside for the calibration
have no part in the values. The machine scores
w0 + <w, x> + the sum over pairs <v_i, v_j> x_i x_j with low-rank v: a pair of terms, such as an
insult and the mention of a group, can count for more than its parts. It is fitted by Adagrad on the
logistic loss over a bounded sample of labelled rows (SAMPLE) and calibrated on a fifth of it.
Texts are read whole, however long.

A null or empty text, or one without words, gets the score of no terms: the calibrated intercept.
Without labelled rows, or with labels of one kind only, every score is the smoothed share of label 1.
Repeated rows get equal scores; an empty table gives no rows; extra columns of docs, whatever their
names, are dropped, those of labels are not read. A null id is held out of nothing and learned from by nobody.
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
BITS, RANK, POWER = 18, 4, 1.5
PREFIXES = (4, 5, 6, 7)


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms, text by text (with repeats), and their bounds."""
    low = fold(data)
    starts, ends, bounds = word_spans(low, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    rows = [span_hashes(low, starts, ends)]
    for n in PREFIXES:
        h = span_hashes(low, starts, np.minimum(ends, starts + n)) * np.uint64(2 * n + 1)
        rows.append(np.where(ends - starts > n, h, rows[0]))
    buckets = (np.stack(rows, 1).ravel() >> np.uint64(64 - BITS)).astype(np.int64)
    return buckets, bounds * len(rows)


class Machine:
    """A fitted factorization machine with its calibration; scale is 0 at buckets that are no terms."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, scale: np.ndarray, a: float, b: float):
        self.scale, self.w0, self.wv, self.a, self.b = scale.astype(np.float32), w0, np.concatenate([w[:, None], v], 1).astype(np.float32), a, b

    def margin(self, own: np.ndarray) -> float:
        x = self.scale[own].astype(np.float64)
        own, x = own[x > 0], x[x > 0]
        if not len(own):
            return self.w0
        parts = self.wv[own] * (x / np.sqrt(x @ x))[:, None]
        sums = parts.sum(0)
        return float(self.w0 + sums[0] + 0.5 * ((sums[1:] ** 2).sum() - (parts[:, 1:] ** 2).sum()))

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        buckets, at = terms(data, offs)
        seen, out = np.zeros(1 << BITS, bool), np.zeros(len(offs) - 1)
        for k in range(len(out)):
            own = buckets[at[k] : at[k + 1]]
            if len(own) < 1 << 12:
                own = np.unique(own)
            else:
                seen[own] = True
                own = np.flatnonzero(seen)
                seen[own] = False
            out[k] = self.margin(own)
        return learn.sigmoid(self.a * out + self.b)


def scales(rows: list[np.ndarray], y: np.ndarray, mindf: int) -> np.ndarray:
    """How much each bucket counts; 0 if fewer than mindf rows have it, which tells those rows apart and no others."""
    n = [np.bincount(np.concatenate([np.zeros(0, int), *(r for r, v in zip(rows, y, strict=True) if (v > 0) == k)]), minlength=1 << BITS) for k in (False, True)]
    size = [(y <= 0).sum(), (y > 0).sum()]
    odds = [np.log((n[k] + 0.5) / (size[k] - n[k] + 0.5)) for k in (0, 1)]
    error = np.sqrt(sum(1 / (n[k] + 0.5) + 1 / (size[k] - n[k] + 0.5) for k in (0, 1)))
    return np.where(n[0] + n[1] >= mindf, np.maximum(np.abs(odds[1] - odds[0]) / error, 1.0) ** POWER, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.3, pairs: float = 0.1, decay: float = 1e-6, mindf: int = 4, seed: int = 5) -> Machine:
    """Adagrad over minibatches, the pair weights at `pairs` of the rate; a fifth of the rows is set aside for the calibration."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Machine(0.0, np.zeros(1 << BITS), np.zeros((1 << BITS, RANK)), np.zeros(1 << BITS), 0.0, float(np.log(p / (1 - p))))
    aside = np.arange(len(y)) % 5 == 0
    scale = scales([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], mindf)
    rows = [r[scale[r] > 0] for r in rows]
    values = [scale[r] / np.sqrt((scale[r] ** 2).sum()) if len(r) else np.zeros(0) for r in rows]
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(1 << BITS), rng.normal(0, 0.05, (1 << BITS, RANK))
    g0, gw, gv = 1e-6, np.full(1 << BITS, 1e-6), np.full((1 << BITS, RANK), 1e-6)
    use = np.array([k for k in np.flatnonzero(~aside) if len(rows[k])], int)
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(epochs):
        rng.shuffle(use)
        for i in range(0, len(use), batch):
            some = use[i : i + batch]
            sizes = np.array([len(rows[k]) for k in some])
            idx, of = np.concatenate([rows[k] for k in some]), np.repeat(np.arange(len(some)), sizes)
            x = np.concatenate([values[k] for k in some])
            edges = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = v[idx] * x[:, None]
            s = np.add.reduceat(vx, edges)
            margin = w0 + np.add.reduceat(w[idx] * x, edges) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), edges))
            e = (learn.sigmoid(margin) - y[some]) * weight[some] / len(some)
            uniq, back = np.unique(idx, return_inverse=True)
            dw = np.bincount(back, e[of] * x, len(uniq)) + decay * w[uniq]
            d = (e[of] * x)[:, None] * (s[of] - vx)
            dv = np.stack([np.bincount(back, d[:, r], len(uniq)) for r in range(RANK)], 1) + decay * v[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            g0 += e.sum() ** 2
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            v[uniq] -= pairs * rate * dv / np.sqrt(gv[uniq])
            w0 -= rate * e.sum() / np.sqrt(g0)
    m = Machine(w0, w, v, scale, 1.0, 0.0)
    held = np.flatnonzero(aside) if len(set(y[aside])) > 1 else np.arange(len(y))
    m.a, m.b = learn.platt(np.array([m.margin(rows[k]) for k in held]), y[held])
    return m


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", keep: list[Column] | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """keep (the id), score and predicted for every row of docs."""
    rows = learn.labelled(docs, labels, label, train, sample, id, text)
    found, _, y = learn.collect(rows, "y", T.IntegerType(), terms)
    machine = docs.sparkSession.sparkContext.broadcast(fit(found, np.array(y, float)))  # 2**BITS * (RANK + 2) numbers
    return learn.score(docs, keep or [F.col(id)], text, "score double", lambda data, offs: [pa.array(machine.value.scores(data, offs))]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learn.held_out("doc_id", 5, 0)
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out, keep=[F.col("doc_id"), out.alias("held_out")])


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}

"""Language by averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

Subwords are runs of three and four bytes of the case-folded text, with everything between words as
one kind of blank. Their embeddings are averaged over the text and a linear layer with softmax reads
the average; both are trained together by stochastic gradient descent in numpy on a bounded sample of
rows with a language (SAMPLE). A temperature is fitted on a fifth of the sample, and the score below
which a prediction counts as rejected is the lowest that keeps the accepted ones of that fifth right
to ACCEPTED; `accepted` says which side a row is on, the prediction itself stays a learned language.

A null text, or one without a letter, gives `und` and score 0, and so does every text if no row has a
language. A text with letters but without any run (shorter than three bytes) gets the prediction of
the mean of no subwords: the bias. Texts are read whole, however long; an empty table gives no rows.
Repeated rows get equal results; extra columns, whatever their names, are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm import learn
from auralake.llm.common import table
from auralake.llm.wordhash import _WORD, fold

#: Rows with a language that are fitted on, at most about.
SAMPLE = 4000
BITS, WIDTH = 16, 16
ACCEPTED = 0.99


def subwords(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, text by text, and their bounds; a text counts as set between blanks."""
    low = fold(data)
    low = np.where(_WORD[low], low, np.uint8(32))
    # A blank before and after each text, so that short words have runs as well.
    n, k = len(low), len(offs) - 1
    b = np.full(n + 2 * k, 32, np.uint32)
    at = np.arange(k) * 2
    where = np.arange(n) + np.repeat(at, np.diff(offs)) + 1
    b[where] = low
    offs = offs + np.concatenate([at, [2 * k]])
    pairs = b[:-1] | b[1:] << np.uint32(8)
    codes, ends = [], []
    for run in (3, 4):
        if len(b) < run:
            return np.zeros(0, np.int64), np.zeros(k + 1, np.int64)
        m = len(b) - run + 1
        c = pairs[:m] | (b[2:] << np.uint32(16) if run == 3 else pairs[2:] << np.uint32(16))
        codes.append((c * np.uint32(2654435761 if run == 3 else 2246822519)) >> np.uint32(32 - BITS))
        ends.append(run)
    # The shorter runs set the bounds; where the longer one would cross into the next text it is left out.
    m = len(codes[0])
    both = np.stack([codes[0], np.append(codes[1], np.uint32(0))[:m]], 1)
    keep = np.ones((m, 2), bool)
    for run in (3, 4):
        for back in range(1, run):
            edge = offs[1:] - back
            keep[edge[(edge >= 0) & (edge < m)], run - 3] = False
    counts = np.concatenate([[0], np.cumsum(keep.sum(1))])
    return both[keep].astype(np.int64), counts[np.minimum(offs, m)]


class Model:
    """table[b] is what a subword of bucket b adds to the logits: its embedding times the linear layer."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, accept: float = 0.0):
        self.langs, self.weights, self.bias, self.temperature, self.accept = langs, weights.astype(np.float32), bias, temperature, accept

    def logits(self, buckets: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        if not len(buckets):
            return self.bias
        if counts is None and len(buckets) > 1 << 14:
            counts = np.bincount(buckets, minlength=1 << BITS)
            return counts.astype(np.float32) @ self.weights / len(buckets) + self.bias
        if counts is None:
            return self.weights[buckets].mean(0, dtype=np.float64) + self.bias
        return counts @ self.weights[buckets].astype(np.float64) / counts.sum() + self.bias

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buckets, at = subwords(data, offs)
        logits = np.array([self.logits(buckets[at[k] : at[k + 1]]) for k in range(len(offs) - 1)]).reshape(-1, len(self.langs))
        p = softmax(logits / self.temperature)
        return p.argmax(1), p.max(1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[np.ndarray], counts: list[np.ndarray], y: list[str], epochs: int = 4, least_steps: int = 800, batch: int = 32, rate: float = 0.5, seed: int = 11) -> Model | None:
    """Minibatch gradient descent with a falling rate; rows are scaled to unit mean."""
    langs = sorted(set(y))
    if not langs:
        return None
    label = np.array([langs.index(v) for v in y])
    rng = np.random.default_rng(seed)
    e, w, bias = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)), rng.normal(0, 0.1, (WIDTH, len(langs))), np.zeros(len(langs))
    aside = np.arange(len(y)) % 5 == 0
    use = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
    a_round = -(-len(use) // batch)
    epochs = max(epochs, -(-least_steps // a_round))  # few rows are gone through more often
    steps, done = epochs * a_round, 0
    seen, place = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64)
    for _ in range(epochs):
        rng.shuffle(use)
        for i in range(0, len(use), batch):
            some = use[i : i + batch]
            sizes = np.array([len(rows[k]) for k in some])
            idx, of = np.concatenate([rows[k] for k in some]), np.repeat(np.arange(len(some)), sizes)
            share = np.concatenate([counts[k] / counts[k].sum() for k in some])
            # A batch as a matrix of rows and the buckets that they have: its products are sums over subwords.
            seen[idx] = True
            own = np.flatnonzero(seen)
            place[own], seen[own] = np.arange(len(own)), False
            held = np.zeros((len(some), len(own)))
            held[of, place[idx]] = share
            x = held @ e[own]
            d = softmax(x @ w + bias)
            d[np.arange(len(some)), label[some]] -= 1
            step = rate * (1 - done / steps)
            dx = d @ w.T
            # Each subword has a small share of an average, so its steps may be larger than those of the layer.
            e[own] -= step * 4 * (held.T @ dx)
            w -= step * x.T @ d / len(some)
            bias -= step * d.mean(0)
            done += 1
    m = Model(langs, e @ w, bias)
    held = np.flatnonzero(aside)
    logits = np.array([m.logits(rows[k], counts[k]) for k in held])
    grid = np.geomspace(0.02, 20, 60)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), label[held]], 1e-12)).mean() for t in grid]
    m.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / m.temperature)
    top, right = p.max(1), p.argmax(1) == label[held]
    order = np.argsort(-top, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPTED
    m.accept = float(top[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return m


def identify(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[Column] | None = None, sample: int = SAMPLE) -> DataFrame:
    """keep (the id), lang_pred, score and accepted for every row of docs."""
    usable = docs.where(train & F.col(lang).isNotNull() & F.col(id).isNotNull() & F.col(text).isNotNull())
    rows = learn.share(usable, usable.count(), sample, id, 7)
    found, counts, y = learn.collect(rows.select(F.col(id).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")), "lang", T.StringType(), subwords, counts=True)
    model = docs.sparkSession.sparkContext.broadcast(fit(found, counts, y))  # 2**BITS numbers a language

    def predicted(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        m = model.value
        if m is None:
            n = len(offs) - 1
            return [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))]
        best, score = m.predict(data, offs)
        return [pa.array([m.langs[i] for i in best], pa.string()), pa.array(score), pa.array(score >= m.accept)]

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = learn.score(docs, [*(keep or [F.col(id)]), lettered.alias("__lettered")], text, "lang_pred string, score double, accepted boolean", predicted)
    has = F.col("__lettered")
    return out.withColumns({"lang_pred": F.when(has, F.col("lang_pred")).otherwise("und"), "score": F.when(has, F.col("score")).otherwise(0.0), "accepted": has & F.col("accepted")}).drop("__lettered")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = learn.held_out("doc_id", 4, 2)
    return identify(table(spark, sf_dir, "documents"), ~out, keep=[F.col("doc_id"), out.alias("held_out")])


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}

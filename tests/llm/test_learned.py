import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm import language, learn, quality, toxicity
from auralake.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_quality_on_held_out_rows(spark, labels):
    r = quality.op7_quality(spark, SF).join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert len(r) > 50 and np.mean([x.predicted == x.quality for x in r]) > 0.9 and all(0 <= x.score <= 1 for x in r)


def test_toxicity_on_held_out_rows(spark, labels):
    r = toxicity.op4_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").select("predicted", "toxic", "score").collect()
    toxic = [x.predicted for x in r if x.toxic]
    clean = [x.predicted for x in r if not x.toxic]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02


def test_language_on_held_out_rows(spark):
    r = language.op9_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([x.lang_pred == x.lang for x in r]) > 0.98
    sure = [x for x in r if x.accepted]
    assert len(sure) > 0.8 * len(r) and np.mean([x.lang_pred == x.lang for x in sure]) > 0.985




def test_the_machine_sums_over_pairs():
    """The margin against the sum over all pairs, term by term."""
    rng = np.random.default_rng(1)
    n = 1 << toxicity.BITS
    w, v, scale = rng.normal(size=n), rng.normal(size=(n, toxicity.RANK)), np.where(rng.random(n) < 0.8, rng.random(n) + 0.5, 0)
    m = toxicity.Machine(0.3, w, v, scale, 1.0, 0.0)
    for size in (0, 1, 2, 40):
        own = np.unique(rng.integers(0, n, size))
        have = [k for k in own if scale[k] > 0]
        length = np.sqrt(sum(scale[k] ** 2 for k in have))
        x = {k: scale[k] / length for k in have}
        want = 0.3 + sum(w[k] * x[k] for k in have) + sum(v[i] @ v[j] * x[i] * x[j] for i in have for j in have if i < j)
        assert abs(m.margin(own) - want) < 1e-4


def test_the_machine_learns_pairs_of_neutral_terms():
    """A text is toxic if both or neither of two words are there, each as frequent in either class: no additive weight helps."""
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        words = [f"filler{rng.integers(0, 60)}" for _ in range(4)] + ["sneer" if a else "chat", "people" if b else "house"]
        texts.append(" ".join(words))
        y.append(float(a == b))
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        rows.append(np.unique(toxicity.terms(raw, np.array([0, len(raw)]))[0]))
    y = np.array(y)
    m = toxicity.fit(rows[:3000], y[:3000], epochs=30, pairs=1.0)
    right = np.mean([(m.margin(r) * m.a + m.b > 0) == v for r, v in zip(rows[3000:], y[3000:], strict=True)])
    m.wv[:, 1:] = 0
    additive = np.mean([(m.margin(r) * m.a + m.b > 0) == v for r, v in zip(rows[3000:], y[3000:], strict=True)])
    assert right > 0.9 and additive < 0.6


def test_dual_descent_reaches_the_optimum():
    """Primal and dual objective meet, the weights are those of alpha, and ratios are counted one by one."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(120)]
    x = [rng.normal(size=len(r)) / np.sqrt(len(r)) for r in rows]
    sign = np.where(rng.random(120) < 0.4, 1.0, -1.0)
    upper = np.where(sign > 0, 1.2, 0.8)
    alpha, w, bias = quality.dual_descent(rows, x, sign, upper, 40, 400, np.random.default_rng(0))
    again = np.zeros(40)
    for r, v, s, a in zip(rows, x, sign, alpha, strict=True):
        again[r] += a * s * v
    assert np.allclose(again, w) and abs((alpha * sign).sum() - bias) < 1e-9 and (alpha >= 0).all() and (alpha <= upper).all()
    loss = sum(u * max(0.0, 1 - s * (w[r] @ v + bias)) for r, v, s, u in zip(rows, x, sign, upper, strict=True))
    norm = (w @ w + bias * bias) / 2
    assert 0 <= norm + loss - (alpha.sum() - norm) + 1e-9 < 0.01 * (norm + loss)

    y = (sign > 0).astype(float)
    r = quality.ratios(rows, y)
    count = lambda j, v: 1 + sum(j in k for k, t in zip(rows, y, strict=True) if t == v)
    for j in (0, 7, 39):
        total = [sum(len(k) for k, t in zip(rows, y, strict=True) if t == v) + quality.TWICE + 1 for v in (0, 1)]
        assert abs(r[j] - np.log(count(j, 1) / total[1]) + np.log(count(j, 0) / total[0])) < 1e-12


def test_language_model_against_a_loop():
    """Logits as averages, the temperature of the least loss, and the acceptance that keeps the share that is right."""
    rng = np.random.default_rng(3)
    rows, counts, y = [], [], []
    for k in range(300):
        lang = ("aa", "bb", "cc")[k % 3]
        mixed = np.concatenate([rng.integers(0, 300, 4) + 300 * "abc".index(lang[0]), rng.integers(0, 900, 12)])
        own, n = np.unique(mixed, return_counts=True)
        rows.append(own)
        counts.append(n)
        y.append(lang)
    m = language.fit(rows, counts, y)
    for r, n in zip(rows[:5], counts[:5], strict=True):
        every = np.repeat(r, n)
        want = np.array([sum(float(m.weights[b, c]) for b in every) / len(every) + m.bias[c] for c in range(3)])
        assert np.allclose(m.logits(every), want, atol=1e-5) and np.allclose(m.logits(r, n), want, atol=1e-5)
    held = range(0, 300, 5)
    logits = [m.logits(rows[k], counts[k]) for k in held]
    label = ["abc".index(y[k][0]) for k in held]
    loss = lambda t: -np.mean([z[c] / t - np.log(np.exp(z / t).sum()) for z, c in zip(logits, label, strict=True)])
    assert all(loss(m.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.02, 20, 60))
    p = [np.exp(z / m.temperature) / np.exp(z / m.temperature).sum() for z in logits]
    right = [v.argmax() == c for v, c in zip(p, label, strict=True) if v.max() >= m.accept]
    assert not right or np.mean(right) >= language.ACCEPTED


@pytest.mark.parametrize("name", ["toxicity", "quality", "language"])
def test_cases(spark, name):
    rows = [(1, None, "en"), (2, "", "en"), (3, "!!! ... 12", None), (4, "good words are here " * 20, "en"), (4, "good words are here " * 20, "en"), (None, "x", "de"), (5, "z " * 100_000, "de"), (6, "schöne worte sind hier " * 20, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "predicted": F.lit(2), "held_out": F.lit(3)})
    marks = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (2, 0, 0), (6, None, None), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for d, l in ((docs, marks), (docs, marks.limit(0)), (docs.limit(0), marks)):
        if name == "toxicity":
            out = toxicity.score_toxicity(d, l, F.lit(True))
        elif name == "quality":
            out = quality.score_quality(d, l, F.lit(True))
            assert quality.keep_good(d, l, F.lit(True)).columns == d.columns
        else:
            out = language.identify(d, F.lit(True))
        got = out.collect()
        assert len(got) == d.count() and all(r.score is not None and 0 <= r.score <= 1 for r in got)
        if name == "language" and got:
            by = {(r.doc_id or 0): r for r in got}
            assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[4].lang_pred in ("en", "de")


def test_language_without_teachers(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    r = language.identify(docs, F.lit(True)).first()
    assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)


def test_scores_do_not_depend_on_the_batch(spark):
    docs = table(spark, SF, "documents").limit(60)
    rows = [np.array([1, 2]), np.array([2, 3])]
    m = toxicity.fit(rows, np.array([0.0, 0.0]))
    assert m.margin(np.array([5])) == 0.0
    data = [r.text.encode() for r in docs.collect()]
    joined, offs = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in data])])
    for f in (toxicity.terms, quality.grams, language.subwords):
        found, at = f(joined, offs)
        for k, b in enumerate(data):
            alone, ends = f(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
            assert np.array_equal(alone, found[at[k] : at[k + 1]]) and ends[-1] == len(alone)

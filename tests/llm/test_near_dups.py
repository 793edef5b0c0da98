import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.llm import near_dups as nd
from auralake.llm.wordhash import text_shingles


def shingles(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return text_shingles(raw, np.array([0, len(raw)]))[2]


def classes(rows):
    """(id, smallest id of its component, over all pairs) of each row."""
    found = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, a in enumerate(found):
        for q, b in enumerate(found[:p]):
            if len(a) and len(b) and nd.weighted_jaccard(a, b) >= nd.LEAST:
                root[find(p)] = find(q)
    least = {}
    for p, (i, _) in enumerate(rows):
        least.setdefault(find(p), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted(((i, least[find(p)]) for p, (i, _) in enumerate(rows)), key=str)


def made(seed=0, groups=12, size=9, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 10**6))
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(n)]
        for _ in range(size):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(0, n))] = word()
            rows.append((i, " ".join(t)))
            i += 1
    return rows


def test_words_are_folded():
    assert np.array_equal(shingles("The ÉTÉ, one two three!"), shingles("the été one  TWO three"))
    assert len(shingles("one two")) == 1 and len(shingles("... !")) == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.8):
        a = {int(x): int(w) for x, w in zip(rng.integers(1, 2**60, 400), rng.integers(1, 6, 400), strict=True)}
        b = {k: v for k, v in a.items() if rng.random() < share} | {int(x): 2 for x in rng.integers(1, 2**60, 50)}
        of = np.repeat([0, 1], [len(a), len(b)])
        h = np.array([*a, *b], np.uint64)
        w = np.array([*a.values(), *b.values()])
        s = nd.dart_signatures(of, h, w, 2, 2000)
        exact = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        assert abs((s[0] == s[1]).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / 2000) + 1e-9


def test_signature_does_not_depend_on_the_company():
    h = np.arange(1, 50, dtype=np.uint64)
    alone = nd.dart_signatures(np.zeros(49, int), h, np.ones(49), 1)
    both = nd.dart_signatures(np.repeat([0, 1], [49, 1]), np.append(h, np.uint64(7)), np.append(np.ones(49), 900.0), 2)
    assert np.array_equal(alone[0], both[0])


def test_classes_equal_brute_force(spark):
    rows = made(5, 8, 25, 40) + [(1000 + k, t) for k, t in enumerate(("a b c", "A, b c", "", "..", "a a a a a a a a", "a a a a a a a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, nd.near_duplicates(df).collect()), key=str) == classes(rows)


def test_a_large_group_of_edited_copies(spark):
    """One passage in 1,200 copies, most of them just under or over the threshold to each other, of unlike lengths."""
    rng = np.random.default_rng(8)
    word = lambda: "w" + str(rng.integers(0, 10**6))
    base, rows = [word() for _ in range(90)], []
    for i in range(1200):
        t = list(base)
        for _ in range(int(rng.integers(0, 5))):
            k = int(rng.integers(0, len(t)))
            if rng.random() < 0.5:
                del t[k]
            else:
                t[k] = "w" + str(rng.integers(0, 4))
        rows.append((i, " ".join(t + [word() for _ in range(int(rng.integers(0, 20)) * int(rng.random() < 0.2))])))
    found = [np.unique(shingles(t), return_counts=True) for _, t in rows]
    vocabulary = {h: k for k, h in enumerate(sorted({int(h) for f in found for h in f[0]}))}
    matrix = np.zeros((len(rows), len(vocabulary)), np.float32)  # occurrences are 1 here
    for k, (h, n) in enumerate(found):
        assert n.max() == 1
        matrix[k, [vocabulary[int(x)] for x in h]] = 1
    both, total = matrix @ matrix.T, matrix.sum(1)
    linked = both / (total[:, None] + total[None, :] - both) >= nd.LEAST - 1e-6
    label = np.arange(len(rows))
    while True:
        new = np.where(linked, label[None, :], len(rows)).min(1)
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert dict(nd.near_duplicates(df).collect()) == dict(enumerate(label.tolist()))


def test_rare_candidates_miss_no_pair(spark):
    rows = made(11, 6, 40, 50)
    df = spark.createDataFrame([(i, i, t) for i, t in rows], "node long, label long, text string")
    got = {tuple(r) for r in nd.rare_candidates(df).collect()}
    found = [shingles(t) for _, t in rows]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if nd.weighted_jaccard(found[i], found[j]) >= nd.LEAST and not np.array_equal(found[i], found[j])}
    same = {(i, j) for j in range(len(rows)) for i in range(j) if np.array_equal(found[i], found[j])}
    assert want <= got and len(got) < 3 * len(want | same)


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, long), (4, long + " end"), (5, long), (None, long), (6, "same text here"), (6, "same text here"), (7, "Same TEXT here.")]
    rows += [(None, "only without an id"), (None, "only without an id"), (None, ""), (-5, "a negative number")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit(3)).withColumn("band", F.lit(1)).withColumn("node", F.lit("x")).withColumn("class", F.lit(0))
    assert sorted(map(tuple, nd.near_duplicates(df).collect()), key=str) == classes(rows)
    left = nd.keep_one(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, None), (2, ""), (3, long), (6, "same text here"), (None, "only without an id"), (None, ""), (-5, "a negative number")], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    """Each text links by itself, whatever id it is under."""
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(7, x), (7, y), (5, y), (9, x + " end"), (None, x), (None, y + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(df).collect()), key=str) == classes(rows)
    assert sorted((r.doc_id, r.text) for r in nd.keep_one(df).collect()) == [(5, y), (7, x)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 100)], "a long, b long")
    got = dict(nd.components(links).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_ids_at_the_ends_of_long(spark):
    """Ids that leave no room below or above them, repeated ones and none: numbers of nodes come from no id."""
    words = [f"w{i}" for i in range(40)]
    near = " ".join([*words[:-1], "x"])
    rows = [(-(2**63), " ".join(words)), (None, near), (2**63 - 1, near + " y"), (2**63 - 1, "another text"), (None, "third text here"), (-(2**63), "another text"), (0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in nd.near_duplicates(df).collect()), key=str) == classes(rows)

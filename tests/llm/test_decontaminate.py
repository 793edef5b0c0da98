import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auralake.llm import decontaminate as dc


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def brute(docs, items):
    """Best similarity for each document and item, over all places of a frame of the item's size."""
    out = {}
    for d, t in docs:
        a = shingles(words(t))
        for i, s in items:
            b = shingles(words(s))
            # No frame has more in common than the whole text; 0.8 takes 0.8 of the item's at least.
            if sum((Counter(a) & Counter(b)).values()) < 0.8 * len(b):
                continue
            for start in range(1 - len(b), len(a)):
                cut = a[max(start, 0) : start + len(b)]
                both = sum((Counter(cut) & Counter(b)).values())
                if both and 9 * both >= 4 * (len(cut) + len(b)):
                    out[d, i] = max(out.get((d, i), 0), round(both / (len(cut) + len(b) - both), 6))
    return out


def test_equals_its_sql(same):
    same(dc.op3_decontaminate, dc.ORACLES["op3_decontaminate"])


def test_planted_passages(spark):
    word = lambda n: " ".join(f"w{(i * 7919) % 1009}" for i in range(n))
    items = [(1, " ".join(f"q{i}" for i in range(30))), (2, " ".join(f"r{i % 6}" for i in range(40))), (3, "one two three"), (4, None), (5, "..."), (6, " ".join(f"s{i}" for i in range(25)))]
    near = [f"q{i}" for i in range(30)]
    near[0] = "changed"
    far = [f"q{i}" if i % 4 else "x" for i in range(30)]
    docs = [(1, items[0][1]), (2, word(50) + " " + items[0][1].upper() + ", " + word(9)), (3, " ".join(near)), (4, " ".join(far)), (5, word(400)), (6, items[1][1]), (7, "One, two: THREE"), (8, None), (9, ""), (10, word(3000) + " " + items[5][1] + " " + items[0][1]), (None, items[0][1]), (11, items[0][1]), (11, items[0][1]), (11, items[5][1]), (12, items[5][1][:-60])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"copy": F.lit(1), "h": F.lit(2), "n": F.lit(3)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(4))
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(d, b).collect()}
    assert got == brute(docs, items)
    assert {k for k, _ in got} >= {1, 2, 3, 6, 7, 10, 11, None} and not {k for k, _ in got} & {4, 5, 8, 9}
    kept = dc.drop_contaminated(d, b)
    stay = [4, 5, 8, 9] + [12] * (12 not in {k for k, _ in got})
    assert kept.columns == d.columns and sorted((r.doc_id or 0) for r in kept.collect()) == stay
    named = d.withColumns({"__bad": F.lit(1), "__copy": F.lit(2), "item_id": F.lit(3), "_id": F.lit(4)})
    left = dc.drop_contaminated(named, b)
    assert left.columns == named.columns and sorted((r.doc_id or 0) for r in left.collect()) == stay
    assert dc.contaminated(d.limit(0), b).count() == 0 and dc.contaminated(d, b.limit(0)).count() == 0


def test_documents_that_begin_within_an_item(spark):
    """Against all window starts: an item less its first word, and with a word deleted among its first five."""
    item = [f"q{i}" for i in range(30)]
    docs = [(1, " ".join(item[1:])), (2, " ".join(item[:2] + item[3:])), (3, " ".join(item[1:] + ["z"] * 50)), (4, " ".join(item[12:])), (5, " ".join(item[:4] + item[5:]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(frame, bench).collect()}
    assert got == brute(docs, [(1, " ".join(item))]) and {d for d, _ in got} == {1, 2, 3, 5}
    assert [r.doc_id for r in dc.drop_contaminated(frame, bench).collect()] == [4]


def test_parts_of_an_item_in_any_order(spark):
    """The halves of an item swapped, items cut off at either end of a document, and a shingle repeated: as brute force has it."""
    rng = random.Random(6)
    item = [f"q{i}" for i in range(100)]
    other = [f"r{i % 7}" for i in range(30)]
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    docs = [(1, item), (2, item[50:] + item[:50]), (3, filler(20) + item[:86]), (4, item[12:] + filler(300)), (5, filler(9) + item[30:70] + item[:30] + item[70:] + filler(9)), (6, other[:20] + filler(4) + other), (7, filler(30) + item[:60] + filler(60) + item[60:])]
    docs += [(10 + k, [w if rng.random() > 0.025 else "x" for w in filler(k) + item + other]) for k in range(25)]
    docs = [(i, " ".join(w)) for i, w in docs]
    items = [(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(item[:99])), (4, " ".join(other + ["end"]))]
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert got == brute(docs, items)
    assert {d for d, _ in got} >= {1, 2, 5, 6} and 7 not in {d for d, i in got if i in (1, 3)}


def test_frames_leave_out_only_what_cannot_reach_the_threshold(spark):
    rng = random.Random(2)
    rows = []
    for d in range(60):
        s, n = rng.randrange(1, 60), rng.randrange(5, 25)
        rows.append((d, n, s, sorted(p for p in range(s) if rng.random() < 0.9)))
    got = {}
    for r in dc.frames(spark.createDataFrame(rows, "d long, n int, s int, p array<int>"), "d").collect():
        assert r.start not in got.setdefault(r.d, set())
        got[r.d].add(r.start)
    for d, n, s, p in rows:
        m = n - 4
        held = {a: (sum(a <= x < a + m for x in p), min(a + m, s) - max(a, 0)) for a in range(1 - m, s)}
        assert got.get(d, set()) == {a for a, (t, c) in held.items() if t and 9 * t >= 4 * (c + m)}


@pytest.mark.parametrize("apart", [0, 16, 40, 63])
def test_blocks_find_all_within_the_radius(spark, apart):
    """Fingerprints that far apart meet in the index, however the bits lie."""
    rng, rows = random.Random(apart), []
    for k in range(40):
        a = [rng.randrange(1 << dc.BITS) for _ in range(dc.BLOCKS)]
        b = list(a)
        bits = rng.sample(range(dc.BLOCKS * dc.BITS), apart) if k else [x * dc.BITS + y for x in range(dc.BLOCKS) for y in range(4)][:apart]
        for x in bits:
            b[x // dc.BITS] ^= 1 << x % dc.BITS
        rows.append((k, a, b))
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    index, asked = dc.filed(df.withColumn("fp", F.col("a")), dc.STORED, "k"), dc.filed(df.withColumn("fp", F.col("b")), dc.ASKED, "k")
    assert index.join(asked, ["k", "block", "value"]).select("k").distinct().count() == 40
    assert df.select(F.size(dc.near(F.lit(77), 2)), F.size(dc.near(F.lit(77), 1))).first() == (137, 17)


def test_fingerprint_is_the_sign_of_sums(spark):
    df = spark.createDataFrame([([1, 3, -1, 12345],)], "h array<bigint>")
    salted = [[r for (r,) in df.select(F.explode("h").alias("h")).select(F.xxhash64("h", F.lit(j))).collect()] for j in range(4)]
    bits = [sum(1 if h >> b & 1 else -1 for h in own) > 0 for own in salted for b in range(64)]
    want = [sum(1 << i for i in range(16) if bits[16 * b + i]) for b in range(16)]
    assert df.select(dc.fingerprint(F.col("h"))).first()[0] == want


def test_no_python_runs(spark):
    plan = dc.contaminated(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_anchors_lose_no_pair_of_the_threshold(spark):
    """Whatever a window of 0.8 similarity lacks of an item, it holds one of its anchors; shingles that repeat included."""
    rng = random.Random(9)
    items = [(k, [rng.randrange(1 + m // (1 + k % 4)) for _ in range(m)]) for k, m in enumerate([1, 2, 4, 5, 6, 9, 10, 26, 61, 100] * 3)]
    df = spark.createDataFrame([(k, len(hs) + 4, hs) for k, hs in items], "it long, n int, hs array<long>")
    held = {}
    for r in dc.anchors(df).collect():
        held.setdefault(r.it, set()).add(r.h)
    for k, hs in items:
        need = -(-4 * len(hs) // 5)
        for _ in range(50):
            assert held[k] & set(rng.sample(hs, need))


def test_recall_by_similarity(spark):
    """Passages with words changed, 0.8 to 1 similar: all that brute force finds over all places are found; few candidates beside them."""
    rng = random.Random(4)
    items = [(k, [f"i{k}w{j}" if rng.random() < 0.8 else f"c{rng.randrange(40)}" for j in range(40 + k)]) for k in range(20)]
    docs = []
    for k, w in items:
        for c in range(12):
            own = list(w)
            for at in rng.sample(range(len(own)), c % 4):
                own[at] = "x"
            docs.append((k * 100 + c, [f"f{rng.randrange(10**6)}" for _ in range(c)] + own + ["y"] * c))
    docs, items = [(d, " ".join(w)) for d, w in docs], [(k, " ".join(w)) for k, w in items]
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        want |= brute([(d, t)], [items[d // 100]])
    assert got == want and sum(v < 0.9 for v in want.values()) > 20

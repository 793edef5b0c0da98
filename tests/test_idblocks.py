import threading

import pytest

from auralake.operators import feedback
from auralake.operators.idblocks import Claims


def test_writers_side_by_side_get_blocks_that_tile(spark, tmp_path):
    got, errors = [], []

    def writer(w):
        try:
            claims = Claims(spark, f"file://{tmp_path}/ids")
            for k in range(8):
                n = 1 + (w * 7 + k) % 5
                got.append((claims.reserve(n, f"{w}-{k}"), n))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=writer, args=(w,)) for w in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(got) == 48
    got.sort()
    assert got[0][0] == 1 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    claims = Claims(spark, f"file://{tmp_path}/ids")
    first = {name: a for a, _, name in claims.held()}
    assert claims.reserve(1 + (2 * 7 + 3) % 5, "2-3") == first["2-3"] and len(claims.held()) == 48


def test_claims_of_other_stores(spark, tmp_path):
    """The form that renames, on a store that is not told to be local."""
    claims = Claims(spark, f"file://{tmp_path}/other")
    claims.local = False
    assert [claims.reserve(n, f"a{n}") for n in (5, 3, 2)] == [1, 6, 9] and claims.reserve(3, "a3") == 6
    assert not claims._put(6, 9, "late") and [h[:2] for h in claims.held()] == [(1, 5), (6, 3), (9, 2)]


@pytest.mark.parametrize("hot", [False, True])
def test_appends_at_once_lose_nothing(spark, hot):
    table, errors = f"votes_at_once_{hot}".lower(), []
    feedback.create(spark, table)
    frames = [spark.createDataFrame([("viral" if hot else f"s{w}-{i}", 1 if i % 2 else -1) for i in range(40 + w)], "audio_id string, feedback int") for w in range(4)]

    def write(w):
        try:
            feedback.append(frames[w], table)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors, errors
    rows = spark.table(table).collect()
    assert sorted(r.id for r in rows) == list(range(1, sum(40 + w for w in range(4)) + 1))
    for batch in {r.batch for r in rows}:
        own = sorted(r.id for r in rows if r.batch == batch)
        assert own == list(range(own[0], own[0] + len(own)))


def test_a_batch_that_is_retried_keeps_its_ids(spark):
    rows = spark.createDataFrame([(f"a{i}", 1) for i in range(10)], "audio_id string, feedback int")
    for _ in range(2):
        feedback.append(rows, "votes_retried", batch="b-1")
        feedback.append(rows.limit(3), "votes_retried", batch="b-2")
    got = spark.table("votes_retried").collect()
    assert sorted(r.id for r in got) == list(range(1, 14))
    feedback.append(rows.limit(0), "votes_retried")
    assert spark.table("votes_retried").count() == 13

"""Arrays of a key that are spread over the whole table."""

import math

from auralake.plans.catalogue import ORACLES, QUERIES
from tests.conftest import SF


def test_a_key_joins_its_rows_of_the_whole_table(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    want = {}
    for r in rows:
        want.setdefault(r.vec_id % 10, []).extend(math.floor(x * 1e4) % 2048 for x in r.embedding)
    assert len(rows) > 10 * 16 and min(map(len, want.values())) > 16 * 64
    got = {r.grp: r.ids for r in QUERIES["arrays_in_order"](spark, SF).collect()}
    assert got == {k: ",".join(map(str, a)) for k, a in want.items()}


def test_rows_in_any_order_with_empty_and_missing_arrays(spark, duck, tmp_path):
    path = tmp_path / "embeddings.parquet"
    array = "CASE WHEN i % 70 = 7 THEN NULL WHEN i % 50 = 13 THEN [] WHEN i % 30 = 11 THEN [NULL, 0.5] WHEN i % 10 = 4 THEN [] ELSE [i / 7.0, -i / 3.0] END::FLOAT[]"
    cursor = duck.cursor()
    cursor.execute(f"COPY (SELECT (i - 200)::BIGINT AS vec_id, {array} AS embedding FROM range(0, 1000) r(i) ORDER BY hash(i)) TO '{path}' (FORMAT parquet)")
    sql = ORACLES["arrays_in_order"]
    want = sorted(cursor.execute(f"WITH embeddings AS (SELECT * FROM read_parquet('{path}')), {sql.removeprefix('WITH ')}").fetchall())
    got = sorted(map(tuple, QUERIES["arrays_in_order"](spark, str(tmp_path)).collect()))
    assert got == want and any(not ids for _, ids in want)

import pytest

from auralake.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_resample_has_gaps(spark):
    rows = QUERIES["metrics_resample"](spark, "/root/testdata/sf0.001")
    assert rows.where("attempts_per_s = 0").count() > 0
    assert rows.where("attempts_per_s = 1 AND std_response_time IS NULL").count() > 0


def test_every_second_has_every_request(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n, seconds = events.selectExpr("count(*)", "unix_seconds(cast(date_trunc('second', max(ts)) AS timestamp)) - unix_seconds(cast(date_trunc('second', min(ts)) AS timestamp)) + 1").first()
    got = QUERIES["metrics_per_second"](spark, "/root/testdata/sf0.001").selectExpr("count(*)", "count(DISTINCT timestamp)", "sum(attempts_per_s)").first()
    assert tuple(got) == (seconds, seconds, n) and seconds > 2_000_000


def test_flagship_has_one_shuffle_by_interval(spark):
    plan = QUERIES["metrics_resample"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_top_n_is_no_full_sort(spark):
    plan = QUERIES["topn_by_tokens"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan

import glob
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{root}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if glob.glob(path + '/*') else path}')")
    return con


def text_of(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text_of, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query's rows over the smallest tables are those of its SQL."""

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(text_of(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
        rel = duck.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        want = sorted(tuple(text_of(r[i]) for i in at) for r in rel.fetchall())
        assert got == want

    return check

"""Intermediate tables: Parquet in the folder that the driver and all executors share.

Files outlive executors, so a lost executor costs a few tasks and not the whole lineage. They stay
until `scope` ends or `release` is called: a DataFrame that was read from them needs them until its
own result is written.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from auralake.config import ship

#: What each open scope has written, innermost last; scopes are for one thread of the driver.
_open: list[list[str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir. Only a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/auralake-scratch"


def folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return f"{root(spark)}/auralake/{spark.sparkContext.applicationId}"


def written(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df, written as Parquet into the shared folder and read again; the planner then knows its size. lasting: it outlives the innermost scope."""
    ship(df.sparkSession)
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if len(_open) > lasting:
        _open[-1 - lasting].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Remove all that this application has written here; DataFrames that read it end with it."""
    delete(spark, folder(spark))


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what is written within; results have to be written elsewhere, or as lasting ones."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)

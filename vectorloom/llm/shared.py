"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="vectorloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vectorloom/{spark.sparkContext.applicationId}"


_to_clean: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of this application's own; all of them go when it ends."""
    home = _home(spark)
    if home not in _to_clean:
        _to_clean.add(home)
        atexit.register(clean_up, spark)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables and files that this application's operators have written: results that read them must be done with."""
    if spark.sparkContext._jsc is not None:
        drop_path(spark, _home(spark))


@contextmanager
def run_once(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run inside drop their shuffle files when they end: nothing reads them again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    What follows does not depend on the executors that made it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with run_once(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() made and nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t._cut_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as make it none of df's columns; case does not tell columns apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""The folder that the driver and all executors share, and tables that are written there once and read several times."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset, which only a local master may do, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-io-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a write go when it ends, not when the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: it is computed once, and lost executors cost no more than a read."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The folders that staged() has written and that haven't been removed yet.
_made: list[str] = []


def drop_staged(spark: SparkSession, *keep: DataFrame) -> int:
    """Removes the folders that staged() has written so far, but for those that keep is read from; how many.

    To be called when what was computed from them has been written: a DataFrame that still reads them would fail.
    """
    bare = lambda p: re.sub(r"^\w+:/*", "/", p)
    kept = {bare(f).rpartition("/")[0] for df in keep for f in df.inputFiles()}
    gone = [p for p in _made if bare(p) not in kept]
    for path in gone:
        remove(spark, path)
        _made.remove(path)
    return len(gone)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any store that Spark reads; none if it isn't there."""
    fs, where = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _folder(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _folder(spark, path)
    fs.delete(where, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders <name>=<n> in path whose writing was finished, ascending."""
    found = [int(c.partition("=")[2]) for c in children(spark, path) if c.startswith(f"{name}=")]
    return sorted(n for n in found if exists(spark, f"{path}/{name}={n}/_SUCCESS"))

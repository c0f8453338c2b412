"""What the operators share: the cluster's shared folder, staged tables, Arrow batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to a Python worker: what a worker makes of a batch is many times its text.
BATCH_ROWS, BATCH_BYTES = 400, 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where that setting is absent, a new temporary folder is made and set for checkpoint(), which only a local master may do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    _made.append(path)
    for s in _open:
        s.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The folders that staged() has written and that haven't been removed yet.
_made: list[str] = []


class Scratch:
    """What is staged and sent to the executors within ``with scratch:``, to be given up by drop() once its results are written."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.broadcasts: list[tuple[str, Broadcast]] = []

    def __enter__(self) -> Scratch:
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)

    def drop(self, spark: SparkSession, *keep: DataFrame) -> None:
        """Removes the folders, but for those that keep is read from, and the executors' and the driver's copies of what was sent."""
        _remove(spark, self.paths, keep)
        for app, b in self.broadcasts:
            if app == spark.sparkContext.applicationId:  # else they are gone with their application
                b.destroy()
        self.broadcasts.clear()


_open: list[Scratch] = []


def sent(spark: SparkSession, value) -> Broadcast:
    """value as a broadcast variable, which the open Scratch gives up later; its size is for the caller to bound."""
    b = spark.sparkContext.broadcast(value)
    for s in _open:
        s.broadcasts.append((spark.sparkContext.applicationId, b))
    return b


def drop_staged(spark: SparkSession, *keep: DataFrame) -> None:
    """Removes the folders that staged() has written so far, but for those that keep is read from.

    To be called when what was computed from them has been written: a DataFrame that still reads them would fail.
    """
    _remove(spark, _made, keep)


def _remove(spark: SparkSession, paths: list[str], keep: tuple[DataFrame, ...]) -> None:
    bare = lambda p: re.sub(r"^\w+:/*", "/", p)
    kept = {bare(f).rpartition("/")[0] for df in keep for f in df.inputFiles()}
    for path in [p for p in paths if bare(p) not in kept]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        for known in (paths, _made):
            if path in known:
                known.remove(path)


_shipped: set[str] = set()


def python_ready(spark: SparkSession) -> None:
    """Prepares a session for this package's Python functions.

    The package goes to the executors' Python path, and Arrow batches follow bytes as well as rows, so that very long
    texts don't fill a Python worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if (app := spark.sparkContext.applicationId) not in _shipped:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{top.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def refuse_taken(df: DataFrame, *new: str | None) -> None:
    """Raises ValueError if df has a column of one of the names, in whatever case."""
    have = {c.lower() for c in df.columns}
    if taken := [n for n in new if n is not None and n.lower() in have]:
        raise ValueError(f"df already has {', '.join(taken)}")


def utf8(col) -> "F.Column":
    """Bytes of a text in UTF-8; a null text counts as empty."""
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")


#: Up to so many short rows (under 100 bytes each in memory) a table is broadcast; beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """df, staged and counted: to be broadcast if its rows are few, else left to Spark's own choice of join."""
    df = staged(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

"""Sinks: parquet by format, replacement of one format, appends of unseen rows, a file a row, tables over JDBC."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_format(df: DataFrame, path: str) -> None:
    """All formats anew."""
    df.write.mode("overwrite").partitionBy("format").parquet(path)


def replace_formats(df: DataFrame, path: str, key: list[str]) -> None:
    """Only the formats that df holds, one row a key; the other formats' files stay."""
    rows = df.groupBy("format", *[k for k in key if k != "format"]).agg(F.max(F.struct(*[c for c in df.columns if c != "format" and c not in key])).alias("r"))
    rows.select(*key, *([] if "format" in key else ["format"]), "r.*").select(*df.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("format").parquet(path)


def swapped_formats(old: DataFrame, new: DataFrame, formats: list[str]) -> DataFrame:
    """old with the rows of formats gone and new's in their place, also where new has none: to be written to a new path."""
    return old.where(~F.col("format").isin(*formats)).unionByName(new.where(F.col("format").isin(*formats)))


def unseen(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The rows of df, one a key, whose key isn't in existing."""
    return df.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def append_unseen(df: DataFrame, existing: DataFrame, path: str, key: list[str]) -> None:
    unseen(df, existing, key).write.mode("append").parquet(path)


def replaced_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the matches of new, and new: to be written to a new path and swapped in."""
    return old.join(new.select("match_id").distinct(), "match_id", "left_anti").unionByName(new)


def write_table(df: DataFrame, url: str, table: str, *, mode: str = "append", batch: int = 1000, truncate: bool = False, **properties: str) -> None:
    """A table over JDBC, straight from the executors."""
    df.write.jdbc(url, table, mode=mode, properties={"batchsize": str(batch), "truncate": str(truncate).lower(), **properties})


def write_files(rows: DataFrame, path: str) -> int:
    """rows (name, content as text) as a file each, called name, under path; how many. Names may hold folders, and tell rows apart.

    Tasks write the files where they belong: Spark's own writers have the driver rename each file when all are done, one after
    another. A task that runs again writes the same files once more. path is of a store that pyarrow knows.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        made, n = set(), 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{root}/{name}"
                if (folder := target.rpartition("/")[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(content.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return rows.select("name", "content").mapInArrow(put, "files long").agg(F.sum("files")).first()[0] or 0

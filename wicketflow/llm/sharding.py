"""Sharding: two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records by seeded hashes into buckets that fit in a task's memory: the shard by rendezvous hashing
of (key, shard), then a sub-bucket of the shard by a second hash. Pass 2 permutes each bucket by Spark's ``shuffle``
(Fisher-Yates on the bucket's rows) and writes it into its shard's folder.

Law ``key``: the key and the number of shards decide the shard; with one more shard, rows only move into that one.
Sub-buckets hash every hashable column and the input partition, so that neither a hot key nor copies of one row
gather in one bucket (copies within one input partition stay together).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicketflow.llm.common import fresh_path


@dataclass(frozen=True)
class Shards:
    """What write_shards() wrote. rows: the input's columns, shard, bucket and the row's place in its bucket."""

    path: str
    rows: DataFrame
    n_shards: int
    seed: int

    def placed(self, *columns: Column | str) -> DataFrame:
        """columns of rows (default: all) with shard and slot: the place in the shard, gapless from 0.

        Columns are computed in the scan, before the join with the buckets' starts, so that it carries no more than them.
        """
        sizes = self.rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        slim = self.rows.select(*(columns or [c for c in self.rows.columns if c not in ("shard", "bucket", "place")]), "shard", "bucket", "place")
        return slim.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.col("place")).drop("start", "bucket", "place")


def rendezvous(key: Column, n_shards: int, seed: int = 0) -> Column:
    """The shard whose seeded hash with the key is largest; a null key is a key of its own."""
    return _best(key, n_shards, seed).getField("shard").cast("int")


def _best(key: Column, n_shards: int, seed: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("\0null"))
    return F.array_max(F.array(*[F.struct(F.xxhash64(text, F.lit(seed), F.lit(s)).alias("score"), F.lit(s).alias("shard")) for s in range(n_shards)]))


def grown_shard(key: Column, n_shards: int, seed: int = 0) -> Column:
    """The key's shard where there is one more: the new one or the old."""
    return rendezvous(key, n_shards + 1, seed)


def write_shards(
    df: DataFrame, key: str, n_shards: int, *, text: str | None = None, seed: int = 0, bucket_bytes: int = 256 << 20, path: str | None = None
) -> Shards:
    """Shuffles df into n_shards folders ``shard=<s>`` of Parquet files under path (default: the shared folder).

    text: the column that makes up the rows' size. bucket_bytes: what a bucket holds at most on average; there are at least
    four buckets a shard, and as many as the session's shuffle partitions, so that all cores have work. A task permutes one
    or two buckets in memory, some four times their bytes each. Columns of df that are called shard, bucket or place,
    in whatever case, are kept under a name with a further underscore, key and text too.

    A null key goes by its own hash, a null text counts no bytes; repeated rows are all kept; an empty df gives no rows.
    """
    spark = df.sparkSession
    taken = {"shard", "bucket", "place"}
    for c in df.columns:
        if c.lower() in taken:
            new = c
            while new.lower() in {x.lower() for x in df.columns} | taken:
                new += "_"
            key, text = (new if x is not None and x.lower() == c.lower() else x for x in (key, text))
            df = df.withColumnRenamed(c, new)
    body = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) if text else F.lit(0)
    total = df.agg(F.sum(body + F.lit(64).cast("long")).alias("n")).first()["n"] or 0
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    subs = max(4, math.ceil(spread / n_shards), math.ceil(total / bucket_bytes / n_shards))
    hashable = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.VariantType) and "map<" not in f.dataType.simpleString()]
    # The input partition keeps copies of one row apart; unlike a running number it is the same when a task runs again.
    row = F.xxhash64(*hashable, F.spark_partition_id(), F.lit(seed))
    scattered = (
        df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), rendezvous(F.col(f"`{key}`"), n_shards, seed).alias("shard"), row.alias("at"))
        .withColumn("bucket", F.pmod(F.col("at"), F.lit(subs)).cast("int"))
        .repartition(max(n_shards * subs // 2, 1), "shard", "bucket")
    )
    order = F.array_sort(F.collect_list(F.struct("at", "row")), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    buckets = scattered.groupBy("shard", "bucket").agg(order.alias("rows")).sortWithinPartitions("shard", "bucket")
    path = path or fresh_path(spark, "shards")
    out = buckets.select("shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "r")).select("r.row.*", "bucket", "place", "shard")
    out.write.partitionBy("shard").parquet(path)
    schema = T.StructType(out.schema.fields)
    return Shards(path, spark.read.schema(schema).parquet(path), n_shards, seed)

"""Order-free digests of tables: what differs between two copies, found without moving the rows that don't.

A row's hash is added to the sum of its key's bucket, so that a table's digest doesn't depend on the order or the partitioning
of its rows, and rows that repeat count as often as they occur. Buckets are the leaves of a tree of sums; two tables are
compared from the root down, and only into nodes that differ. Of the rows in buckets that differ, two numbers are shuffled, the
key's hash and the row's; only rows of keys whose hashes don't cancel out are read again, and grouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketflow.sources.shared import staged

#: Bits of a bucket's number, and of a step down the tree.
BITS, STEP = 16, 4
#: The most unequal keys that are broadcast (16 MB as numbers).
MOST_KEYS = 2**21
#: A bucket with so many times the rows that are due to it holds keys that repeat.
HEAVY = 64


def bucket(key: list[str], bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - bits)


def _hash(columns: list[str], salt: int) -> Column:
    """64 bits of a row: of its columns, and of which of them are null (a hash alone passes over nulls)."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns], F.concat(*[F.when(F.col(f"`{c}`").isNull(), "n").otherwise("v") for c in columns]), F.lit(salt))


def leaves(table: DataFrame, key: list[str], columns: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """(bucket, n, s1 to s4): rows of each bucket, and the sums of the four halves of two hashes of its rows.

    One pass with partial sums: at most 2 ** bits rows a task are shuffled. columns: what is compared (default: all, in order of
    name); columns of type map can't be hashed.
    """
    columns = sorted(columns or table.columns)
    hashed = table.select(bucket(key, bits).alias("bucket"), _hash(columns, 1).alias("a"), _hash(columns, 2).alias("b"))
    # halves: sums of 32-bit numbers don't overflow 64 bits below two thousand million rows a bucket
    halves = [F.sum(h).alias(f"s{i}") for i, h in enumerate((F.col("a").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("a", 32), F.col("b").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("b", 32)), 1)]
    return hashed.groupBy("bucket").agg(F.count("*").alias("n"), *halves)


def level(nodes: DataFrame, down: int, bits: int = BITS) -> DataFrame:
    """(node, n, s1 to s4): the nodes at depth down of the tree over leaves()."""
    return nodes.groupBy(F.shiftrightunsigned("bucket", bits - down).alias("node")).agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "s1", "s2", "s3", "s4")])


def root(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """One row (n, s1 to s4) for the whole table; none if it's empty."""
    return level(nodes, 0, bits).drop("node")


def unequal_buckets(a: DataFrame, b: DataFrame, bits: int = BITS, step: int = STEP) -> list[int]:
    """The buckets in which two leaves() differ, found from the root down: a node that is equal on both sides isn't entered.

    At most 2 ** bits numbers come to the driver; bits is a multiple of step.
    """
    open_nodes: list[int] = []
    for depth in range(0, bits + 1, step):
        inside = F.shiftrightunsigned("bucket", bits - depth + step).isin(open_nodes) if depth else F.lit(True)
        x, y = (level(side.where(inside), depth, bits).select("node", F.struct("n", "s1", "s2", "s3", "s4").alias(k)) for side, k in ((a, "x"), (b, "y")))
        open_nodes = [r["node"] for r in x.join(y, "node", "full").where("NOT (x <=> y)").select("node").collect()]
        if not open_nodes:
            break
    return sorted(open_nodes)


def _within(table: DataFrame, key: list[str], buckets: list[int], bits: int) -> DataFrame:
    if len(buckets) <= 1000:
        return table.where(bucket(key, bits).isin(buckets))
    few = table.sparkSession.createDataFrame([(x,) for x in buckets], "_bucket long")  # at most 2 ** bits rows
    return table.withColumn("_bucket", bucket(key, bits)).join(F.broadcast(few), "_bucket", "left_semi").drop("_bucket")


def _heavy(tops: list[DataFrame], buckets: list[int], bits: int) -> list[int]:
    """Those of the buckets that have over HEAVY times the rows, on either side, that are due to one of 2 ** bits: few, since most can't."""
    found: set[int] = set()
    for top in tops if buckets else []:
        due = max(1, (top.agg(F.sum("n").alias("n")).first()["n"] or 0) / 2**bits)
        found.update(r["bucket"] for r in top.where(F.col("n") > HEAVY * due).select("bucket").collect())
    return sorted(found.intersection(buckets))


def unequal_keys(source: DataFrame, target: DataFrame, key: list[str], buckets: list[int], heavy: list[int] | None = None, bits: int = BITS) -> DataFrame:
    """(key): the hashes of the keys in buckets whose rows differ between tables of the same columns.

    A row is dealt as two hashes and its side, whatever its width; under a key, target's are taken off source's. Most keys have
    one row a side, so nothing is summed before the shuffle, but in heavy buckets, where keys repeat. A key passes for equal
    wrongly where 64 bits agree.
    """
    columns = sorted(source.columns)
    sides = [_within(t, key, buckets, bits).select(F.xxhash64(*key).alias("key"), _hash(columns, 1).alias("row"), F.lit(sign).cast("byte").alias("sign")) for t, sign in ((source, 1), (target, -1))]
    rows, repeats = sides[0].unionByName(sides[1]), F.shiftrightunsigned("key", 64 - bits).isin(heavy or [])
    halves = [F.sum(F.col("sign") * h).alias(f"s{i}") for i, h in enumerate((F.col("row").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("row", 32)))]
    sums = rows.where(~repeats).repartition("key").groupBy("key").agg(*halves)
    if heavy:
        sums = sums.unionByName(rows.where(repeats).groupBy("key").agg(*halves))
    return sums.where("s0 <> 0 OR s1 <> 0").select("key")


def differences(source: DataFrame, target: DataFrame, key: list[str], bits: int = BITS, most: int = MOST_KEYS) -> DataFrame:
    """key, kind, columns: the keys whose rows differ between two copies of a table.

    kind: missing (from target), extra (in target), changed (columns names what), repeated (one side has several rows of the key,
    and they aren't the same on both). target may have its columns in another order or of other types; they are cast to
    source's. Equal tables cost a pass over each and no row moved; else two hashes of each row in differing buckets are shuffled,
    and then the rows of differing keys. Beyond most such keys, all rows of differing buckets are shuffled, once.
    """
    target = target.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in source.schema])
    tops = [staged(leaves(t, key, bits=bits), "digest_leaves") for t in (source, target)]
    buckets = unequal_buckets(*tops, bits)
    columns, values = sorted(source.columns), [c for c in source.columns if c not in key]
    keys = staged(unequal_keys(source, target, key, buckets, _heavy(tops, buckets, bits), bits), "digest_keys") if buckets else None
    few = keys is not None and keys.count() <= most

    def side(table: DataFrame, number: int) -> DataFrame:
        hashes = [_hash(columns, n).cast("decimal(38,0)").alias(h) for n, h in ((1, "_a"), (2, "_b"))]
        rows = _within(table, key, buckets, bits).select(*key, F.xxhash64(*key).alias("_key"), F.lit(number).alias("_side"), *hashes, F.struct(F.lit(0).alias("_"), *values).alias("_row"))
        return rows.join(F.broadcast(keys.withColumnRenamed("key", "_key")), "_key", "left_semi") if few else rows

    def of(number: int, name: str) -> list[Column]:
        here = F.col("_side") == number
        return [F.count(F.when(here, 1)).alias(f"_{name}n"), *[F.sum(F.when(here, F.col(h))).alias(f"_{name}{h}") for h in ("_a", "_b")], F.any_value(F.when(here, F.col("_row")), ignoreNulls=True).alias(f"_{name}row")]

    both = side(source, 0).unionByName(side(target, 1)).groupBy(*key).agg(*of(0, "x"), *of(1, "y"))
    same = reduce(Column.__and__, [F.col(f"_x{c}").eqNullSafe(F.col(f"_y{c}")) for c in ("n", "_a", "_b")])
    kind = F.when(F.col("_yn") == 0, "missing").when(F.col("_xn") == 0, "extra").when((F.col("_xn") > 1) | (F.col("_yn") > 1), "repeated").otherwise("changed")
    named = F.array(*[F.when(~F.col(f"_xrow.`{c}`").eqNullSafe(F.col(f"_yrow.`{c}`")), F.lit(c)) for c in values]) if values else F.array().cast("array<string>")
    return both.where(~same).withColumn("kind", kind).select(*key, "kind", F.when(F.col("kind") == "changed", F.array_compact(named)).otherwise(F.array().cast("array<string>")).alias("columns"))

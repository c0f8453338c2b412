"""Merkle manifest of a dataset: trees of digests built in Spark, and a recursive query that climbs them leaf by leaf.

Each row of a table is a leaf; the leaves of a group, in order of their ids, are paired level by level down to the group's
subroot, and the subroots, in order of the groups, likewise to the root. Built levels are stored as node rows that name
their parent row. A node row stands for a node of every ``STRIDE``-th level and holds the siblings on the way up to its
parent row, so that a climb takes a join for every ``STRIDE`` levels instead of one a level. The recursive query starts with
all leaves, and in each step appends the next row's siblings to the proof and folds them into the digest that it carries.

No task sees more than a range of the ordered leaves, or one block of ``2 ** STRIDE`` neighbours. Leaves are numbered by
ranges: counted in each, then summed over the ranges of a group. The rows of a node that more than ``SALT_ROWS`` leaves
climb through are repeated under several salts, so that no join key gets more rows than that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.llm.common import staged

#: Levels between a node row and its parent row; leaves that may climb through one join key.
STRIDE, SALT_ROWS = 8, 1_000_000
#: Up to so many node rows above the leaves (some 600 bytes each) are broadcast to the climb; beyond, it joins by a shuffle.
BROADCAST_NODES = 20_000
#: The tree over the subroots; those of the groups are called "-" (null) or "=" and the group, which sorts null first.
TOP = "^"
#: In SQL: the digest of one digest or two, as hex texts; a digest folded with siblings; the siblings' digests.
ALONE, JOINED = "unhex(sha2(lower(hex({0})), 256))", "unhex(sha2(concat(lower(hex({0})), lower(hex({1}))), 256))"
FOLD = f"aggregate({{1}}, {{0}}, (h, s) -> CASE WHEN s.digest IS NULL THEN {ALONE.format('h')} WHEN s.left THEN {JOINED.format('s.digest', 'h')} ELSE {JOINED.format('h', 's.digest')} END)"
GATHER = "aggregate({0}, X'', (p, s) -> concat(p, coalesce(s.digest, X'')))"


_OWN = {"tree", "level", "pos", "digest", "siblings", "parent", "salts", "n", "below", "start", "ticket", "leaf", "subroot", "root", "folded", "proof"}


@dataclass(frozen=True)
class Manifest:
    """What build() made.

    nodes: tree, level, pos, digest (null above the leaves, but for a subroot), siblings, parent (tree, level, pos, salts; null
    at the root), salts, and on the leaves' rows (level 0) what was carried. root: binary; None for an empty table.
    """

    nodes: DataFrame
    carried: tuple[str, ...]
    root: bytes | None


def encoded(*values: Column) -> Column:
    """The values one after the other: ``-`` for null, else the UTF-8 bytes' number, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def leaf(*values: Column) -> Column:
    """The digest of a row, binary."""
    return F.unhex(F.sha2(encoded(*values), 256))


def text(digest: Column) -> Column:
    """A binary digest in lower-case hex."""
    return F.lower(F.hex(digest))


def build(df: DataFrame, group: str, key: str, digest: Column, **carry: Column) -> Manifest:
    """The trees over df's rows: one for each group, leaves in ascending order of key, and one over the groups' subroots.

    digest: a row's leaf, binary. carry: further columns that the leaves' rows keep, besides key. A null group is a group of
    its own and comes first; null keys come first in theirs; rows of one key are ordered by their digests, and rows that are
    equal in that, too, take places in any order. An empty df gives no nodes and no root. Other columns don't matter, whatever
    their names; raises ValueError if a carried name is one of the manifest's own.
    """
    if taken := [c for c in (key, *carry) if c.lower() in _OWN]:
        raise ValueError(f"the manifest has columns of its own called {', '.join(taken)}")
    carry = {key: F.col(f"`{key}`"), **carry}
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    rows = staged(df.select(tree.alias("tree"), digest.alias("digest"), *(c.alias(name) for name, c in carry.items())), "merkle_leaves")
    kept = tuple(carry)
    numbered, largest = _numbered(rows, "tree", key, "digest")
    parts, subroots = _levels(numbered.withColumn("below", F.lit(1).cast("long")), largest, kept)
    if not largest:
        return Manifest(staged(parts[0], "merkle_nodes"), kept, None)
    tops, groups = _numbered(subroots.withColumnRenamed("tree", "group").withColumn("tree", F.lit(TOP)), "tree", "group")
    above, roots = _levels(tops, groups, ("group",))
    # a group's last row has the row of its subroot in the tree above as its parent, found by the group's name
    above[0] = above[0].withColumns({"tree": F.col("group"), "level": F.lit(-1), "pos": F.lit(0).cast("long")}).drop("group")
    last = F.col("parent.level") == -1
    above = [a.withColumn("parent", F.when(~last, F.col("parent"))) for a in above]
    nodes = parts[0]
    for more in [*parts[1:], *above]:
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    return Manifest(staged(nodes, "merkle_nodes"), kept, bytes(roots.first()["digest"]))


def _numbered(rows: DataFrame, tree: str, *order: str) -> tuple[DataFrame, int]:
    """rows (read from written files) with pos (gapless from 0 in each tree) and n (rows of the tree); the largest n.

    They are dealt by ranges of tree and order, counted there, and the counts summed over the ranges of a tree. Rows that are
    equal in all of these are dealt apart by their place in the files, which is the same when a task runs again.
    """
    keys = [F.asc_nulls_first(c) for c in (tree, *order)]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    ordered = staged(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle_order").withColumn("_part", F.shiftright("_at", 33))
    counts = ordered.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(tree)).alias("n"))
    starts = staged(starts, "merkle_starts")
    placed = ordered.join(starts, [tree, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_start"))
    return placed.drop("_at", "_part", "_first", "_start"), starts.agg(F.max("n")).first()[0] or 0


def _levels(nodes: DataFrame, largest: int, carried: tuple[str, ...]) -> tuple[list[DataFrame], DataFrame]:
    """The node rows of each STRIDE-th level, and each tree's last node (tree, digest, below). largest: leaves of the largest tree."""
    parts, ended, level = [], [], 0
    while True:
        rows, nodes = _blocks(nodes, level, carried if level == 0 else ())
        parts.append(rows)
        ended.append(nodes.where("n = 1").select("tree", "digest", "below"))
        nodes, level, largest = nodes.where("n > 1"), level + 1, -(-largest // (1 << STRIDE))
        if largest <= 1:
            break
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return parts, staged(out, "merkle_subroots")


def _blocks(nodes: DataFrame, level: int, carried: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The rows of a level's nodes, in blocks of 2 ** STRIDE neighbours; what the blocks come to, STRIDE levels up.

    A tree of one block ends where one node remains.
    """
    grouped = nodes.groupBy("tree", F.shiftright("pos", STRIDE).alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "below", *carried))).alias("rows"))
    height = f"CASE WHEN n <= 1 THEN 0 WHEN n <= {1 << STRIDE} THEN CAST(ceil(log2(n)) AS INT) ELSE {STRIDE} END"
    pair = f"CASE WHEN 2 * i + 1 < size(v) THEN {JOINED.format('v[2 * i]', 'v[2 * i + 1]')} ELSE {ALONE.format('v[2 * i]')} END"
    above = f"transform(array(element_at(made, -1)), v -> transform(sequence(0, (size(v) - 1) DIV 2), i -> {pair}))"
    levels = f"aggregate(slice(sequence(1, {STRIDE}), 1, height), array(transform(rows, r -> r.digest)), (made, k) -> concat(made, {above}))"
    built = grouped.withColumn("height", F.expr(height)).withColumn("levels", F.expr(levels)).withColumn("total", F.expr("aggregate(rows, 0L, (s, r) -> s + r.below)"))
    built = staged(built, "merkle_blocks")
    at = "CAST(shiftright(i, k - 1) AS INT)"
    sibling = f"named_struct('left', {at} % 2 = 1, 'digest', get(levels[k - 1], {at} + 1 - 2 * ({at} % 2)))"
    fields = ", ".join(f"'{c}', r.`{c}`" for c in ("pos", "digest", "below", *carried))
    each = f"transform(rows, (r, i) -> named_struct({fields}, 'siblings', transform(slice(sequence(1, {STRIDE}), 1, height), k -> {sibling})))"
    salts = lambda rows: F.ceil(F.col(rows) / SALT_ROWS).cast("long")
    ends = F.col("n") <= 1 << STRIDE
    parent = F.struct(
        F.col("tree"), F.when(ends, -1).otherwise(level + 1).alias("level"), F.when(ends, 0).otherwise(F.col("block")).cast("long").alias("pos"), salts("total").alias("salts")
    )
    rows = built.select("tree", F.lit(level).alias("level"), parent.alias("parent"), F.explode(F.expr(each)).alias("r"))
    rows = rows.select("tree", "level", "r.*", "parent").withColumn("salts", salts("below")).drop("below")
    over = built.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << STRIDE)).cast("long").alias("n"), F.expr("element_at(levels, -1)[0]").alias("digest"), F.col("total").alias("below"))
    return rows, over


CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT {{{{carried}}}}, pos AS ticket, digest AS leaf, CAST(NULL AS BINARY) AS subroot, {FOLD.format('start', 'siblings')} AS folded, {GATHER.format('siblings')} AS proof, parent FROM {{leaves}}
  UNION ALL
  SELECT {{{{climbing}}}}, c.ticket, c.leaf, coalesce(c.subroot, n.subroot), {FOLD.format('c.folded', 'n.siblings')}, concat(c.proof, {GATHER.format('n.siblings')}), n.parent
  FROM climb c JOIN {{upper}} n ON n.tree = c.parent.tree AND n.level = c.parent.level AND n.pos = c.parent.pos AND n.salt = pmod(c.ticket, c.parent.salts))
SELECT {{{{carried}}}}, leaf, subroot, folded, proof FROM climb WHERE parent IS NULL
"""


def climb(manifest: Manifest, start: Column | None = None) -> DataFrame:
    """A row for each leaf: what was carried, leaf, subroot, root, folded and proof, binary.

    start: the digest that the climb starts from, over a leaf's row (default: the leaf's own digest, then folded equals root).
    proof: the siblings' digests from the leaf to the root, one after the other; nodes alone in their run have none.
    """
    nodes, spark = manifest.nodes, manifest.nodes.sparkSession
    leaves = nodes.where("level = 0").where(F.col("tree") != TOP).withColumn("start", F.col("digest") if start is None else start)
    upper = nodes.where(f"level <> 0 OR tree = '{TOP}'").select("tree", "level", "pos", "siblings", "parent", F.when(F.col("level") == -1, F.col("digest")).alias("subroot"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    upper = staged(upper, "merkle_upper")
    if upper.count() <= BROADCAST_NODES:
        upper = F.broadcast(upper)
    names = ", ".join(f"`{c}`" for c in manifest.carried)
    climbing = ", ".join(f"c.`{c}`" for c in manifest.carried)
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # the default refuses results of over a million rows
    try:
        rows = staged(spark.sql(CLIMB.replace("{{carried}}", names).replace("{{climbing}}", climbing), leaves=leaves, upper=upper), "merkle_climb")
    finally:
        spark.conf.set(limit, before)
    return rows.withColumn("root", F.lit(manifest.root).cast("binary"))

"""Exact top-k search by inner product with M-trees.

Inner product becomes distance by one more coordinate: with M the largest norm of the vectors, x gets
sqrt(M^2 - |x|^2) and a query 0, so |q - x|^2 = |q|^2 + M^2 - 2 <q, x>. Vectors go to the region of the nearest pivot; each
region is an M-tree (a large one several, dealt by hash): pages of entries around a routing vector, with covering radius
and distance to the parent's routing vector. A search pops the page with the smallest possible distance first, skips
entries whose stored distances and the triangle inequality put beyond the k-th best so far, and computes scores in integers.

The regions are the topmost pages: their pivots and covering radii are a small table, by which a query is sent to the trees
that may hold a score of at least the k-th best among a bounded sample of vectors, and to no others. Vectors are shuffled
to their trees once, in copies only where a tree has more queries than one task should answer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.llm.common import python_ready, small_side, staged

#: Vectors in a tree and queries in a pack, about; entries of a leaf page and of an inner page; vectors of the sample.
TREE, QUERIES, LEAF, INNER, SAMPLE = 16_384, 8192, 256, 16, 1024
#: Regions at most, and vectors of the sample for each.
REGIONS, PER_REGION = 1024, 8


@dataclass
class Page:
    """An M-tree page. inner: children's numbers; leaf: the slice of vectors. pivot, radius and to_parent: of its region."""

    pivot: np.ndarray
    radius: float
    to_parent: float
    children: list[int]
    first: int
    last: int


@dataclass
class MTree:
    pages: list[Page]
    ids: np.ndarray
    vectors: np.ndarray
    to_pivot: np.ndarray
    top: float
    largest: float


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 0) -> MTree:
    """Bulk loading: vectors go to the nearest of random pivots, page by page, until a leaf holds them."""
    x = vectors.astype(np.float64)
    norms = (x * x).sum(axis=1)
    top = float(norms.max(initial=0.0))
    z = np.column_stack([x, np.sqrt(np.maximum(top - norms, 0))])
    rng, pages, order = np.random.default_rng(seed), [], []
    to_pivot = np.zeros(len(ids))
    far = lambda at, p: np.sqrt(((z[at] - p) ** 2).sum(axis=1))

    def add(at: np.ndarray, parent: np.ndarray | None) -> int:
        mean = z[at].mean(axis=0)
        pivot = z[at[far(at, mean).argmin()]]
        own = far(at, pivot)
        me = len(pages)
        pages.append(Page(pivot, float(own.max(initial=0.0)), 0.0 if parent is None else float(np.sqrt(((pivot - parent) ** 2).sum())), [], 0, 0))
        if len(at) <= LEAF:
            pages[me].first, pages[me].last = len(order), len(order) + len(at)
            order.extend(at.tolist())
            to_pivot[len(order) - len(at) : len(order)] = own
            return me
        seeds = rng.choice(at, min(INNER, -(-len(at) // LEAF)), replace=False)
        nearest = np.stack([far(at, z[s]) for s in seeds]).argmin(axis=0)
        groups = [at[nearest == k] for k in range(len(seeds))]
        if max(map(len, groups)) == len(at):  # all at one point: any even split will do
            groups = np.array_split(at, len(seeds))
        pages[me].children = [add(g, pivot) for g in groups if len(g)]
        return me

    if len(ids):
        add(np.arange(len(ids)), None)
    at = np.array(order, dtype=np.int64)
    return MTree(pages, ids[at], vectors[at], to_pivot, top, float(np.abs(x).max(initial=0.0)))


def search(tree: MTree, query_id: int, query: np.ndarray, k: int, bound: float = -math.inf) -> list[tuple[int, int]]:
    """The k best (score, id) of a tree without the query's own id, as far as scores reach bound."""
    if not tree.pages:
        return []
    exact = tree.largest * float(np.abs(query).max(initial=0)) * len(query) < 2**52
    kind = np.float64 if exact else object
    v, q = tree.vectors.astype(kind, copy=False), query.astype(kind)
    z = np.append(query.astype(np.float64), 0.0)
    size = float(z @ z) + tree.top

    def reach(score: float) -> float:
        """The distance beyond which no score reaches this one."""
        if score == -math.inf:
            return math.inf
        d = math.sqrt(max(0.0, size - 2 * score))
        return d + 1e-6 * (1 + math.sqrt(size))

    best: list[tuple[int, int]] = []  # (score, -id), worst first
    limit = reach(bound)
    root = tree.pages[0]
    d = float(np.sqrt(((root.pivot - z) ** 2).sum()))
    heap = [(max(0.0, d - root.radius), 0, d)]
    while heap:
        least, n, d = heapq.heappop(heap)
        if least > limit:
            break
        page = tree.pages[n]
        if page.children:
            for c in page.children:
                child = tree.pages[c]
                if abs(d - child.to_parent) - child.radius > limit:
                    continue
                own = float(np.sqrt(((child.pivot - z) ** 2).sum()))
                if own - child.radius <= limit:
                    heapq.heappush(heap, (max(0.0, own - child.radius), c, own))
            continue
        near = np.flatnonzero(np.abs(d - tree.to_pivot[page.first : page.last]) <= limit) + page.first
        if not len(near):
            continue
        scores = (v[page.first : page.last] @ q)[near - page.first] if 2 * len(near) > page.last - page.first else v[near] @ q
        for i in np.flatnonzero(scores >= (best[0][0] if len(best) == k else bound)):
            own_id, score = int(tree.ids[near[i]]), int(scores[i])
            if own_id == query_id:
                continue
            if len(best) < k:
                heapq.heappush(best, (score, -own_id))
            elif (score, -own_id) > best[0]:
                heapq.heapreplace(best, (score, -own_id))
        if len(best) == k:
            limit = min(limit, reach(best[0][0]))
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null where the vector is null or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


@dataclass
class Regions:
    """Of the vectors of one length: pivots, the largest squared norm, covering radii, trees in each, and the sample."""

    pivots: np.ndarray
    top: float
    radius: np.ndarray
    trees: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray

    def distances(self, x: np.ndarray, last: np.ndarray | float) -> np.ndarray:
        """Of vectors x with last as their added coordinate to each pivot."""
        z = np.column_stack([x, np.broadcast_to(last, len(x))])
        squares = (z * z).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None, :] - 2 * z @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))

    def slack(self) -> float:
        """More than what rounding does to a distance."""
        return 1e-6 * (1 + math.sqrt(self.top))


def plan(ids: np.ndarray, vectors: np.ndarray, n: int, top: float) -> Regions:
    """Pivots for n vectors from a sample of them: means of groups, improved in a few rounds."""
    x = vectors.astype(np.float64)
    z = np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))])
    k = int(max(1, min(-(-n // TREE), REGIONS, len(z) // PER_REGION)))
    pivots = z[np.random.default_rng(0).choice(len(z), k, replace=False)]
    for _ in range(5):
        own = ((z[:, None, :] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1) if k < 64 else ((z * z).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * z @ pivots.T).argmin(axis=1)
        pivots = np.stack([z[own == i].mean(axis=0) if (own == i).any() else pivots[i] for i in range(k)])
    return Regions(pivots, top, np.zeros(k), np.zeros(k, np.int64), ids, vectors)


def top_k(df: DataFrame, is_query: Column, k: int, *, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query by integer inner product, ties to smaller ids.

    vector: array of long; rows where it or the id is null take no part. Vectors meet those of their own length only, a row
    never meets its own id; a query with no other row gives none. An id that repeats is searched for, and found, once a row.
    Raises ValueError where a score could leave 64 bits.
    """
    spark = df.sparkSession
    python_ready(spark)
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<long>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = staged(rows.where("id is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    lengths = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("top")).collect()  # a row a length
    if any(r["top"] >= 2.0**62 for r in lengths):
        raise ValueError("scores may be beyond 64 bits")
    most = 8 * PER_REGION * REGIONS
    want = max(SAMPLE, PER_REGION * max((-(-r["n"] // TREE) for r in lengths), default=1))
    share = min(1.0, want / max(1, sum(r["n"] for r in lengths)))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "v", "dim").limit(min(4 * want, most)).toPandas()  # bounded by most
    sample = {dim: (g["id"].to_numpy(), np.stack(g["v"].to_numpy())) for dim, g in some.groupby("dim")}
    none = lambda dim: (np.zeros(1, np.int64), np.zeros((1, dim), np.int64))
    regions = {r["dim"]: plan(*sample.get(r["dim"], none(r["dim"])), r["n"], r["top"]) for r in lengths}
    for dim in regions.keys() - sample.keys():
        regions[dim].ids, regions[dim].vectors = np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
    first = spark.sparkContext.broadcast(regions)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, region, far = batch.column(3).to_numpy(), np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim in np.unique(dims):
                own, at = first.value[dim], np.flatnonzero(dims == dim)
                x = _matrix(batch.column(1).take(pa.array(at)), dim)
                d = own.distances(x, np.sqrt(np.maximum(own.top - (x * x).sum(axis=1), 0)))
                region[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(far)], names=["id", "v", "q", "dim", "region", "far"])

    dealt = staged(rows.select("id", "v", "q", "dim").mapInArrow(assign, "id long, v array<long>, q boolean, dim int, region int, far double"), "regions")
    first.destroy()
    for r in dealt.groupBy("dim", "region").agg(F.count("*").alias("n"), F.max("far").alias("radius")).toLocalIterator():  # at most REGIONS a length
        regions[r["dim"]].radius[r["region"]] = r["radius"]
        regions[r["dim"]].trees[r["region"]] = -(-r["n"] // TREE)
    known = spark.sparkContext.broadcast(regions)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            bounds, trees = np.full(len(batch), -math.inf), [[] for _ in ids]
            for dim in np.unique(dims):
                own, at = known.value[dim], np.flatnonzero(dims == dim)
                x = _matrix(batch.column(1).take(pa.array(at)), dim)
                size = (x * x).sum(axis=1) + own.top
                if len(own.ids) > k + 1 and float(np.abs(own.vectors).max()) * float(np.abs(x).max()) * dim < 2**52:
                    s = x @ own.vectors.astype(np.float64).T
                    s[ids[at][:, None] == own.ids[None, :]] = -math.inf
                    bounds[at] = np.partition(s, -k, axis=1)[:, -k]
                reach = np.sqrt(np.maximum(size - 2 * bounds[at], 0)) + own.slack()
                near = own.distances(x, 0.0) - own.radius <= reach[:, None]
                for i, row in zip(at, near):
                    trees[i] = [{"region": int(r), "sub": int(j)} for r in np.flatnonzero(row) for j in range(own.trees[r])]
            kind = pa.list_(pa.struct([("region", pa.int32()), ("sub", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bounds), pa.array(trees, kind)], names=["id", "v", "dim", "bound", "trees"])

    key = ["dim", "region", "sub"]
    asked = dealt.where("q").select("id", "v", "dim").mapInArrow(send, "id long, v array<long>, dim int, bound double, trees array<struct<region int, sub int>>")
    asked = staged(asked.select("id", "v", "dim", "bound", F.explode("trees").alias("t")).select("id", "v", "dim", "bound", "t.region", "t.sub"), "asked")
    packs = small_side(asked.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("packs")), "packs")
    counts = [(dim, i, int(n)) for dim, own in regions.items() for i, n in enumerate(own.trees) if n]
    trees = F.broadcast(spark.createDataFrame(counts, "dim int, region int, trees int"))
    body = dealt.join(trees, ["dim", "region"]).withColumn("sub", F.pmod(F.xxhash64("id", "v", F.spark_partition_id()), F.col("trees")).cast("int"))
    body = body.join(packs, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("packs") - F.lit(1))).alias("pack"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("bound"))
    query = asked.join(packs, key).select(*key, F.pmod(F.xxhash64("id", "v"), F.col("packs")).cast("int").alias("pack"), F.lit(1).alias("kind"), "id", "v", "bound")
    met = body.unionByName(query).repartition(*key, "pack").sortWithinPartitions(*key, "pack", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, tree = None, [], [], None  # the vectors of a tree come before its queries
        for batch in batches:
            out = []
            v, kinds, own_ids, bounds = batch.column(6), batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(7)
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and kinds[end] == kinds[at]:
                    end += 1
                if keys[at] != now:
                    now, ids, vectors, tree = keys[at], [], [], None
                part = np.array(v.slice(at, end - at).to_pylist(), dtype=np.int64)
                if kinds[at] == 0:
                    ids.append(own_ids[at:end])
                    vectors.append(part)
                elif ids or tree is not None:
                    if tree is None:
                        tree = build(np.concatenate(ids), np.concatenate(vectors))
                        if tree.largest < 2**50:
                            tree.vectors = tree.vectors.astype(np.float64)
                        ids, vectors = [], []
                    for own, q, bound in zip(own_ids[at:end].tolist(), part, bounds.slice(at, end - at).to_pylist()):
                        out.extend((own, i, s) for s, i in search(tree, own, q, k, bound))
                at = end
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)

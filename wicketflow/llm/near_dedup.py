"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A text's words (runs of letters, digits and non-ASCII bytes, lower-cased) give shingles of five; a shingle's weight is its
count in the text times its inverse document frequency. ICWS draws BANDS * ROWS samples whose agreement between two texts
estimates their weighted Jaccard similarity; texts that agree on all samples of a band are candidates, and a candidate
pair is a link if the weighted Jaccard similarity of the two whole texts is at least the threshold. Classes are the
connected components of the links, with equal texts together.

- Document frequencies are counted over all documents in a table of COUNTERS counters (its size doesn't follow the data),
  less what other shingles are expected to add to a counter. They are counted twice: at first each document counts for
  one, then for one over the median frequency of its own shingles. So a family of copies, whose shingles are frequent
  *because* of the copies, counts about once, while a passage that otherwise different documents share counts in full.
- The inverse document frequency is ln((N + SMOOTH) / (df + SMOOTH)), in sixteenths of its largest value.
- The random numbers of ICWS (two gamma variables and a uniform one) come from a table of 65536 triples, looked up by a
  hash of shingle and sample number; equal draws are told apart by the shingle's hash.
- A bucket of at most PAIRS texts is compared pair by pair. In a larger one, every text is compared with a pivot, the text
  that shares most buckets with others. Then every two texts of a large bucket that are not yet in one class are compared,
  unless one of three bounds shows that they are no link: the weighted Jaccard distance is a metric, so the distances to the
  pivot differ by at most that of the pair; the rarest shingle that two linked texts share stands in both prefixes; and
  what they have in common is no more, in any cell of shingles, than either has that other texts have too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.llm.common import free_name, python_ready, small_side, staged
from wicketflow.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
COUNTERS, BLOCKS = 1 << 18, 16
#: Added to document frequencies: below it they hardly differ. Weights are in LEVELS steps.
SMOOTH, LEVELS = 32, 16
PAIRS = 8
#: Cells into which a text's shingles are summed up, to bound what two texts have in common.
CELLS = 32
#: Bytes of text that are hashed at once.
CHUNK = 2 << 20
DRAWS = 1 << 16

_rng = np.random.default_rng(20240607)
_place = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_order = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_sample = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_r, _ln_c, _beta = _rng.gamma(2, 1, DRAWS), np.log(_rng.gamma(2, 1, DRAWS)), _rng.random(DRAWS)
_is_word = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sum_of(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(a, starts) if len(starts) else np.zeros(0, a.dtype)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, their counts, and where each text's begin and end.

    A text of one to four words has one shingle of all of them; a null text or one without words has none.
    """
    hashes, counts, ends = [], [], [0]
    raw = [t.lower().encode("utf-8") if t else b"" for t in texts]
    k = 0
    while k < len(raw):
        size, j = len(raw[k]), k + 1
        while j < len(raw) and size + len(raw[j]) <= CHUNK:
            size, j = size + len(raw[j]), j + 1
        for h, n in _chunk_shingles(raw[k:j]):
            hashes.append(h)
            counts.append(n)
            ends.append(ends[-1] + len(h))
        k = j
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.array(ends)
    return np.concatenate(hashes), np.concatenate(counts), np.array(ends)


def _chunk_shingles(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a = np.frombuffer(b"\0".join([b"", *raw, b""]), dtype=np.uint8)
    own = _is_word[a]
    at = np.flatnonzero(own)
    first = np.flatnonzero(~own[at - 1])  # a word's first byte among at
    length = np.diff(np.append(first, len(at)))
    offset = np.arange(len(at)) - np.repeat(first, length)
    words = _mix(_sum_of((a[at].astype(np.uint64) + np.uint64(1)) * _place[offset & 63], first) + length.astype(np.uint64))
    edges = np.cumsum([1, *(len(r) + 1 for r in raw)])
    cuts = np.searchsorted(at[first], edges)  # the words of text i: cuts[i] to cuts[i + 1]
    rolled = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
    for j in range(WORDS):
        rolled += words[j : j + len(rolled)] * _order[j]
    rolled = _mix(rolled)
    for i, j in zip(cuts, cuts[1:]):
        if j - i >= WORDS:
            yield np.unique(rolled[i : j - WORDS + 1], return_counts=True)
        elif j > i:
            yield _mix((words[i:j] * _order[: j - i]).sum(keepdims=True)), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


#: A document's count, so that shares of it are whole numbers.
_ONE = 1 << 16


def _frequencies(texts: DataFrame, before: np.ndarray | None) -> tuple[np.ndarray, float]:
    """(document frequency of each counter's shingles, number of documents); before: the frequencies of the first count."""
    block = COUNTERS // BLOCKS
    known = texts.sparkSession.sparkContext.broadcast(before)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, df = np.zeros(COUNTERS, np.int64), 0, known.value
        for batch in batches:
            h, _, ends = shingles(batch.column(0).to_pylist())
            at, sizes = _counter(h), np.diff(ends)
            own = np.full(len(sizes), _ONE, np.int64)
            if df is not None:
                for i in np.flatnonzero(sizes):
                    own[i] = _ONE // max(1.0, float(np.median(df[at[ends[i] : ends[i + 1]]])))
            n += int(own.sum())
            total += np.bincount(at, weights=np.repeat(own, sizes), minlength=COUNTERS).astype(np.int64)
        if n:
            rows = [total[i : i + block].tobytes() for i in range(0, COUNTERS, block)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(rows, pa.binary()), pa.array([n] * BLOCKS, pa.int64())], names=["block", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        docs_of: dict[int, int] = {}
        for batch in batches:
            for k, raw, n in zip(*(c.to_pylist() for c in batch.columns)):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
                docs_of[k] = docs_of.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()), pa.array(docs_of.values(), pa.int64())], names=["block", "counts", "n"])

    schema = "block int, counts binary, n long"
    rows = texts.mapInArrow(count, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect()  # BLOCKS rows, 2 MB in all
    known.destroy()
    if not rows:
        return np.ones(COUNTERS), 0.0
    c = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["block"])]) / _ONE
    return np.maximum((c * COUNTERS - c.sum()) / (COUNTERS - 1), 1.0), rows[0]["n"] / _ONE


def idf_levels(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each counter, the inverse document frequency (1 to LEVELS) of the shingles that it counts."""
    python_ready(docs.sparkSession)
    texts = docs.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    first, n = _frequencies(texts, None)
    df, _ = _frequencies(texts, first)
    idf = np.log((n + SMOOTH) / (np.minimum(df, n) + SMOOTH))
    top = np.log((n + SMOOTH) / (1 + SMOOTH))
    return np.clip(np.rint(LEVELS * idf / top), 1, LEVELS).astype(np.uint8) if top > 0 else np.full(COUNTERS, LEVELS, np.uint8)


def _draw(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ICWS's value a for each weight, by the triple at index, as an integer in the upper half of 64 bits."""
    r, beta = _r[index], _beta[index]
    t = np.floor(np.log(weight) / r + beta)
    return np.exp(_ln_c[index] - r * (t - beta + 1)).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)


_draws_once: list[np.ndarray] = []


def signatures(h: np.ndarray, tf: np.ndarray, ends: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples of each text that has shingles, in order."""
    if not _draws_once:  # for the weights of shingles that occur once
        _draws_once.append(np.concatenate([_draw(np.arange(DRAWS), np.full(DRAWS, float(w))) for w in range(1, LEVELS + 1)]))
    level = levels[_counter(h)].astype(np.int64)
    many = np.flatnonzero(tf > 1)
    low, base = h & np.uint64(0xFFFFFFFF), (level - 1) * DRAWS
    starts = ends[:-1][np.diff(ends) > 0]
    out = np.empty((len(starts), BANDS * ROWS), dtype=np.uint64)
    weight = (level * tf)[many].astype(float)
    for k, m in enumerate(_sample):
        index = ((h * m) >> np.uint64(48)).astype(np.int64)
        key = _draws_once[0][base + index]
        if len(many):
            key[many] = _draw(index[many], weight)
        out[:, k] = np.minimum.reduceat(key | low, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each text and band."""
    x = signature.reshape(len(signature), BANDS, ROWS)
    mixed = (_mix(x) * _order[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return _mix(mixed).view(np.int64)


def _bands(docs: DataFrame, levels: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, tf, ends = shingles(batch.column(1).to_pylist())
            own = np.flatnonzero(np.diff(ends) > 0)
            if len(own):
                keys = band_keys(signatures(h, tf, ends, levels.value))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), lists], names=["node", "bands"])

    return docs.select("node", "text").mapInArrow(run, "node binary, bands array<long>")


def _weighted(docs: DataFrame, levels: Broadcast) -> DataFrame:
    """(node, hashes, weights) with shingle hashes in order and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, tf, ends = shingles(batch.column(1).to_pylist())
            w = (levels.value[_counter(h)] * tf).astype(np.uint32)
            spans = list(zip(ends, ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h[i:j].tobytes() for i, j in spans], pa.binary()), pa.array([w[i:j].tobytes() for i, j in spans], pa.binary())],
                names=["node", "hashes", "weights"],
            )

    return docs.select("node", "text").mapInArrow(run, "node binary, hashes binary, weights binary")


def similarity(ha: bytes, wa: bytes, hb: bytes, wb: bytes) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    x, y = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
    u, v = np.frombuffer(wa, np.uint32).astype(np.int64), np.frombuffer(wb, np.uint32).astype(np.int64)
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    same = np.flatnonzero(y[at] == x) if len(y) else np.zeros(0, np.int64)
    common = int(np.minimum(u[same], v[at[same]]).sum())
    return common / (int(u.sum()) + int(v.sum()) - common)


def prefix(h: bytes, w: bytes, levels: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles of a text, by level and hash, so many that the others don't weigh enough for a link."""
    x = np.frombuffer(h, np.uint64)
    order = np.lexsort((x, -levels[_counter(x)].astype(np.int64)))
    u = np.frombuffer(w, np.uint32).astype(np.int64)[order]
    return x[order[np.cumsum(u) - u <= (1 - threshold) * u.sum() + 1e-6]].view(np.int64)


def _prefixes(weighted: DataFrame, levels: Broadcast, threshold: float) -> DataFrame:
    """(node, prefix, cells): the prefix of each text, and the weight of its shingles in each of CELLS cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ws = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [prefix(h, w, levels.value, threshold) for h, w in zip(hs, ws)]
            cells = [np.bincount(_cell(np.frombuffer(h, np.uint64)), np.frombuffer(w, np.uint32), CELLS).astype(np.int64) for h, w in zip(hs, ws)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int64()))], names=["node", "prefix", "cells"])

    return weighted.select("node", "hashes", "weights").mapInArrow(run, "node binary, prefix array<long>, cells array<long>")


def _cell(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).astype(np.int64)


def _shared_cells(weighted: DataFrame, own: DataFrame) -> DataFrame:
    """own with shared: the weight in each cell of the shingles that stand in more than one of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs = [np.frombuffer(h, np.uint64) for h in batch.column(1).to_pylist()]
            numbers = np.repeat([int.from_bytes(n[:8], "big", signed=True) for n in batch.column(0).to_pylist()], [len(h) for h in hs])
            w = np.concatenate([np.frombuffer(x, np.uint32) for x in batch.column(2).to_pylist()]).astype(np.int64) if hs else np.zeros(0, np.int64)
            flat = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(numbers.astype(np.int64)), pa.array(w)], names=["h", "number", "w"])

    each = weighted.select("node", "hashes", "weights").mapInArrow(run, "h long, number long, w long")
    alone = each.groupBy("h").agg(F.count("*").alias("n"), F.max("number").alias("number"), F.max("w").alias("w")).where("n = 1")
    cell = F.col("h").bitwiseAND(F.lit(CELLS - 1))
    alone = alone.groupBy("number").agg(F.array(*[F.coalesce(F.sum(F.when(cell == i, F.col("w"))), F.lit(0)) for i in range(CELLS)]).alias("alone"))
    number = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")  # the first eight bytes, signed
    shared = F.when(F.col("alone").isNull(), F.col("cells")).otherwise(F.zip_with("cells", "alone", lambda x, y: x - y))
    return own.withColumn("number", number).join(alone, "number", "left").withColumn("shared", shared).drop("number", "alone")


def _scored(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """(a, b, s) for the pairs (a, b): s is their weighted Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, wa, hb, wb = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            s = pa.array([similarity(*x) for x in zip(ha, wa, hb, wb)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), s], names=["a", "b", "s"])

    left = weighted.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
    right = weighted.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "wa", "hb", "wb")
    return both.mapInArrow(run, "a binary, b binary, s double")


def _unclassed(spokes: DataFrame, roots: DataFrame, weighted: DataFrame, levels: Broadcast, threshold: float) -> DataFrame:
    """The pairs (a, b) of texts that share a large bucket, are in different classes by roots, and may yet be a link.

    spokes: (key, node, pivot, s), each text of a large bucket, the pivot too, with its similarity to the pivot. In each
    bucket, the texts outside its most frequent class meet all those of other classes, by a join that Spark splits.
    """
    classed = spokes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classed = staged(classed.select("key", "node", "pivot", "s", "root"), "classed")
    sizes = classed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    open_ = sizes.agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main")).where("roots > 1").select("key", "main")
    texts = staged(classed.join(small_side(open_, "open"), "key"), "unclassed")
    some = staged(weighted.join(texts.select("node").distinct(), "node", "left_semi"), "compared")
    own = _shared_cells(some, _prefixes(some, levels, threshold))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    own = own.select("node", "prefix", "shared", total("cells").alias("whole"), total("shared").alias("most"))
    texts = staged(texts.join(own, "node").select("key", "node", "s", "root", "main", "prefix", "shared", "whole", "most"), "prefixed")
    x, y = texts.where("root <> main").alias("x"), texts.alias("y")
    # what two linked texts have in common weighs at least so much, and no more than what each has that isn't its own alone
    least = (F.col("x.whole") + F.col("y.whole")) * (threshold / (1 + threshold)) - 1e-6
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.abs(F.col("x.s") - F.col("y.s")) <= 1 - threshold + 1e-9)
    near = near & (F.least("x.most", "y.most") >= least) & (total(F.zip_with("x.shared", "y.shared", lambda a, b: F.least(a, b))) >= least)
    both = x.join(y, near & F.arrays_overlap("x.prefix", "y.prefix"))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots with the classes joined that links connect: components of the classes, whose number is far smaller."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = staged(components(between), "tops")
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(tops.join(roots.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, class_id, class_node) for each row of docs; class_id is the smallest doc_id of its class.

    node: the MD5 of the text; rows with equal texts share a class whatever the text is. Null texts are compared with
    nothing and are each their own class (node is null); so are the classes of texts without words. class_id is null
    only where no row of the class has an id. Other columns are not read.
    """
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("node", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    levels = spark.sparkContext.broadcast(idf_levels(rows))
    banded = rows.where(F.col("node").isNotNull())
    ids = banded.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    keyed = staged(_bands(banded, levels).select("node", "bands").dropDuplicates(["node"]), "bands").select("node", F.explode("bands").alias("key"))
    found = staged(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "buckets")
    few = found.where(F.col("n") <= PAIRS).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    few = few.select("nodes", F.posexplode("nodes").alias("i", "a")).select("a", F.explode(F.slice("nodes", F.col("i") + 2, F.lit(PAIRS))).alias("b"))
    large = found.where(F.col("n") > PAIRS)
    ranked = large.join(large.groupBy("node").agg(F.sum("n").alias("met")), "node")
    pivots = staged(ranked.groupBy("key").agg(F.max_by("node", F.struct("met", "node")).alias("pivot")), "pivots")
    spokes = staged(large.join(pivots, "key").select("key", "node", "pivot"), "spokes")
    star = spokes.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    pairs = staged(few.unionByName(star).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(ids, "node")
    wanted = wanted.select("node", F.col("doc_id").alias("first_id"))
    texts = banded.join(small_side(wanted, "wanted"), "node").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    weighted = staged(_weighted(texts, levels).dropDuplicates(["node"]), "weighted")
    scored = staged(_scored(pairs, weighted), "scored")
    roots = staged(components(scored.where(F.col("s") >= threshold).select("a", "b")), "roots")
    if not spokes.isEmpty():
        at = (F.least("node", "pivot") == F.col("a")) & (F.greatest("node", "pivot") == F.col("b"))
        spokes = spokes.join(scored, at, "left").select("key", "node", "pivot", F.coalesce("s", F.lit(1.0)).alias("s"))
        rest = _unclassed(spokes, roots, weighted, levels, threshold).join(scored, ["a", "b"], "left_anti")
        more = staged(_scored(staged(rest, "rest"), weighted).where(F.col("s") >= threshold).select("a", "b"), "links")
        roots = roots if more.isEmpty() else _joined(roots, more)
    levels.destroy()  # all that follows reads written tables
    known = rows.select("doc_id", "node").join(roots, "node", "left").withColumn("class_node", F.coalesce("root", "node")).drop("root")
    # staged, so that the join below reads two shuffles and a large class is split like any skewed key
    firsts = staged(known.where(F.col("class_node").isNotNull()).groupBy("class_node").agg(F.min("doc_id").alias("class_id")), "firsts")
    return known.join(firsts, "class_node", "left").select(
        "doc_id", "node", F.when(F.col("class_node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_node"
    )


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each near-duplicate class: one with the class's smallest id; all columns as they are.

    Rows with null text all stay. Of rows that repeat id and text, one stays.
    """
    classes = staged(near_duplicates(docs, doc_id=doc_id, text=text, threshold=threshold), "classes").where(F.col("class_node").isNotNull())
    chosen = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_node").agg(F.min("node").alias("chosen"))
    rows = classes.groupBy("class_node", "node", "doc_id", "class_id").agg(F.count("*").alias("n")).join(chosen, "class_node")
    stays = (F.col("node") == F.col("chosen")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    rows = staged(rows.select("node", "doc_id", stays.alias("stays"), "n"), "kept")
    own_node, own_id, own_place = (free_name(docs, x) for x in ("_node", "_id", "_place"))
    gone = small_side(rows.where(~F.col("stays")).select(F.col("node").alias(own_node), F.col("doc_id").alias(own_id)), "gone")
    node = F.unhex(F.md5(F.encode(F.col(f"`{text}`"), "UTF-8")))
    left = docs.join(gone, (node == F.col(own_node)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)), "left_anti")
    if rows.where("stays and n > 1").isEmpty():
        return left
    key = [F.col(f"`{doc_id}`"), node]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    ordered = left.where(F.col(f"`{text}`").isNotNull()).withColumn(own_place, place).where(F.col(own_place) == 1).drop(own_place)
    return ordered.unionByName(left.where(F.col(f"`{text}`").isNull()))

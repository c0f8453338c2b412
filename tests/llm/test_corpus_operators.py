"""Sharding, near duplicates, search and the pipeline against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wicketflow.llm import graph, near_dedup, sharding, top_k


def test_shards(spark):
    rows = [(i, "x" * (i % 50)) for i in range(3000)] + [(None, None)] * 300 + [(7, "same")] * 300
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, bucket int").repartition(8)
    placed = sharding.write_shards(df, "doc_id", 5, text="text", seed=3, bucket_bytes=4096).placed().cache()
    assert placed.count() == len(rows) and {"shard_", "bucket_"} <= set(placed.columns)
    for r in placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r["n"] == r["d"] == r["m"] + 1
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    moved = placed.select("shard", sharding.grown_shard(F.col("doc_id"), 5, 3).alias("grown"), sharding.rendezvous(F.col("doc_id"), 5, 3).alias("own"))
    assert moved.where("own <> shard").count() == 0 and moved.where("grown <> shard and grown <> 5").count() == 0
    ids = [r["doc_id"] for r in placed.where("shard = 0 and doc_id > 7").orderBy("slot").collect()]
    assert ids != sorted(ids)  # shuffled
    assert sharding.write_shards(df.limit(0), "doc_id", 5, text="text").placed().count() == 0


def test_crc32_is_unsigned_utf8(spark):
    assert spark.range(1).select(F.crc32(F.encode(F.lit("é§"), "UTF-8")).alias("c")).first()["c"] == zlib.crc32("é§".encode())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(100)] + [(None, 3), (5, 5)]
    own = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            own[y] = x
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in own}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(t):
    import re

    return re.findall(r"[^\W_]+", t.lower())


def test_near_duplicates_equal_brute_force(spark):
    """Classes by the weighted similarity of all pairs of texts."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    texts = []
    for k in range(60):
        w = rng.choices(vocabulary, k=rng.choice([3, 20, 80, 300]))
        texts.append(" ".join(w))
        for edits in rng.choices([0, 1, 2, 5, 12, 40], k=rng.choice([0, 1, 4])):
            v = w[:]
            for _ in range(edits):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" ".join(v))
    base = rng.choices(vocabulary, k=150)
    for _ in range(60):  # a bucket far above PAIRS
        v = base[:]
        v[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(v))
    rows = [*enumerate(texts), (900, None), (901, None), (902, ""), (903, "..."), (904, "..."), (905, texts[0]), (905, texts[0]), (None, texts[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = near_dedup.near_duplicates(df).collect()
    levels = near_dedup.idf_levels(df)
    h, tf, ends = near_dedup.shingles(texts)
    weights = [dict(zip(h[i:j].tolist(), (levels[near_dedup._counter(h[i:j])] * tf[i:j]).tolist())) for i, j in zip(ends, ends[1:])]
    own = list(range(len(texts)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = weights[i], weights[j]
            common = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            if common and common / (sum(a.values()) + sum(b.values()) - common) >= 0.8:
                x, y = sorted((root(i), root(j)))
                own[y] = x
    classes = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert {i: classes[i] for i in range(len(texts))} == {i: root(i) for i in range(len(texts))}
    assert classes[900] == 900 and classes[901] == 901 and classes[902] == 902 and classes[903] == classes[904] == 903 and classes[905] == classes[0]
    assert len(got) == len(rows)
    kept = near_dedup.deduplicate(df)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted({root(i) for i in range(len(texts))} | {900, 901, 902, 903}) and kept.columns == df.columns
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def classes_of(texts, levels):
    """The smallest index of each text's class, by the weighted similarity of all pairs."""
    h, tf, ends = near_dedup.shingles(texts)
    w = [(h[i:j], levels[near_dedup._counter(h[i:j])].astype(int) * tf[i:j]) for i, j in zip(ends, ends[1:])]
    own = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if own[i] != own[j]:
                _, x, y = np.intersect1d(w[i][0], w[j][0], assume_unique=True, return_indices=True)
                common = np.minimum(w[i][1][x], w[j][1][y]).sum()
                if common >= 0.8 * (w[i][1].sum() + w[j][1].sum() - common):
                    a, b = sorted((own[i], own[j]))
                    own = [a if k == b else k for k in own]
    return own


@pytest.mark.parametrize("hubs", [1, 0, 2])
def test_spokes_of_a_hub(spark, hubs):
    """Copies that are near the original and not near each other; with no original; with a second original near a few of them."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(600)]
    texts = [" ".join(base)] if hubs else []
    for _ in range(300):
        v = base[:]
        for at in rng.sample(range(0, 600, 6), 10):  # 50 of 596 shingles
            v[at] = f"e{rng.random()}"
        texts.append(" ".join(v))
    if hubs == 2:
        second = base[:]
        for at in range(3, 600, 30):  # 100 shingles: not near the first
            second[at] = f"s{at}"
        texts += [" ".join(second)] + [" ".join(second[: 6 * k] + ["new"] + second[6 * k + 1 :]) for k in range(20)]
        between = base[:]
        for at in range(3, 300, 30):
            between[at] = f"s{at}"
        texts.append(" ".join(between))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    own = classes_of(texts, near_dedup.idf_levels(df))
    assert [got[i] for i in range(len(texts))] == own
    assert hubs != 1 or set(own) == {0}


def test_prefixes_of_links_meet():
    rng = np.random.default_rng(4)
    levels = rng.integers(1, 17, near_dedup.COUNTERS).astype(np.uint8)
    met = 0
    for n in [1, 2, 5, 30, 200] * 40:
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        x, y = (np.unique(np.concatenate([base[rng.random(n) > 0.03], rng.integers(0, 2**64, n // 60, dtype=np.uint64)])) for _ in range(2))
        u, v = (levels[near_dedup._counter(z)].astype(np.uint32) for z in (x, y))
        if near_dedup.similarity(x.tobytes(), u.tobytes(), y.tobytes(), v.tobytes()) >= 0.8:
            met += 1
            assert set(near_dedup.prefix(x.tobytes(), u.tobytes(), levels, 0.8)) & set(near_dedup.prefix(y.tobytes(), v.tobytes(), levels, 0.8))
    assert met > 20


def test_weights_of_long_repeats(spark):
    df = spark.createDataFrame([(b"a", "word " * 6004), (b"b", "word " * 60004)], "node binary, text string")
    near_dedup.python_ready(spark)
    levels = spark.sparkContext.broadcast(np.full(near_dedup.COUNTERS, 16, np.uint8))
    x, y = sorted(near_dedup._weighted(df, levels).collect())
    assert near_dedup.similarity(x["hashes"], x["weights"], y["hashes"], y["weights"]) == 0.1


def test_frequencies_count_families_once(spark):
    """A passage in many different texts gets a low weight, a text with many near copies doesn't."""
    rng = random.Random(8)
    word = lambda: f"w{rng.random()}"
    passage, base = [word() for _ in range(20)], [word() for _ in range(60)]
    texts = [" ".join([*(word() for _ in range(40)), *passage]) for _ in range(400)]
    texts += [" ".join([*base[:30], word(), *base[30:]]) for _ in range(400)] + [" ".join(word() for _ in range(60)) for _ in range(1200)]
    levels = near_dedup.idf_levels(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    own = lambda w: levels[near_dedup._counter(near_dedup.shingles([" ".join(w)])[0])]
    assert own(passage).max() <= 8 and np.median(own(base[:30])) >= 14 and np.median(own(texts[-1].split())) >= 15


def test_copies_of_one_text_with_one_to_five_edits(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        v = base[:]
        for at in rng.sample(range(120), rng.randint(1, 5)):
            v[at] = f"e{rng.random()}"
        texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    own = classes_of(texts, near_dedup.idf_levels(df))
    # a lone text may share no band with the others; no two classes that hold linked texts of one bucket stay apart
    assert sum(got[i] == own[i] for i in range(150)) >= 148


def test_shingles_do_not_depend_on_batches():
    texts = ["One two, three FOUR five six", None, "", "one", "a b c d e f g a b c d e"] * 3
    h, n, ends = near_dedup.shingles(texts)
    for i, t in enumerate(texts):
        x, y, _ = near_dedup.shingles([t])
        assert (h[ends[i] : ends[i + 1]] == x).all() and (n[ends[i] : ends[i + 1]] == y).all()
    assert ends[1] - ends[0] == 2 and ends[4] - ends[3] == 1


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    x, y = a[:330], a[50:]
    levels = np.full(near_dedup.COUNTERS, 16, np.uint8)
    h, ends = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
    s = near_dedup.signatures(h, np.ones(len(h), np.int64), ends, levels)
    assert abs((s[0] == s[1]).mean() - 280 / 400) < 0.2


@pytest.mark.parametrize("scale", [1, 2**40])
def test_top_k_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(top_k, "TREE", 60)
    monkeypatch.setattr(top_k, "LEAF", 8)
    rng = np.random.default_rng(0)
    v = rng.integers(-9, 9, (400, 6))
    v[100:180] = v[100]  # ties
    v = v * (scale if scale == 1 else 2**20)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1] * 6), (500, None), (501, [1, 2])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, vector array<long>, score int")
    got = sorted(tuple(r) for r in top_k.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(v[q].astype(object) @ v[i].astype(object)), i) for i in range(400) if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_search_skips_pages():
    rng = np.random.default_rng(3)
    centres = rng.integers(-500, 500, (20, 8))
    v = np.concatenate([c + rng.integers(-3, 3, (200, 8)) for c in centres])
    tree = top_k.build(np.arange(len(v)), v)
    q = v[17]
    assert [i for _, i in top_k.search(tree, 17, q, 5)] == [i for _, i in sorted((-int(v[i] @ q), i) for i in range(len(v)) if i != 17)[:5]]
    for p in tree.pages:
        assert p.radius >= 0


def test_quantised(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [])], "vec_id long, v array<float>")
    assert {r["vec_id"]: r["q"] for r in df.select("vec_id", top_k.quantised(F.col("v")).alias("q")).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "mail a@b.co the cat and the dog", None, "s", 31)], docs.schema)
    docs, sizes = docs.unionByName(odd), []
    for name, stage in c.STAGES:
        docs = c.staged(stage(spark, docs, "/root/testdata/sf0.001"), name)
        sizes.append(docs.count())
        if name != "encode":
            assert docs.columns == columns
        if name == "pii":
            assert docs.where("doc_id = -3").first()["text"] == "mail [EMAIL] the cat and the dog"
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] == sizes[4] > 150 and docs.where("doc_id in (-1, -2)").count() == 0

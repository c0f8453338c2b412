"""Name parts by their rarest runs, chains of merges, digests of copies."""

from __future__ import annotations

import random
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wicketflow.operators import digests, grams, identity, names, quality
from wicketflow.sources import shared


def test_holders_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choice("ab c") for _ in range(rng.randrange(12)))) for i in range(80)] + [(90, None), (91, "ababab"), (91, "ababab"), (92, "aaa")]
    asked = sorted({t[k : k + n] for _, t in texts if t for k in range(len(t)) for n in (1, 2, 3, 4, 6)} | {"zzz", "abz", "", "aaaa"})
    got = grams.holders(spark.createDataFrame([(a,) for a in asked] + [(None,), ("aaa",)], "part string"), spark.createDataFrame(texts, "id int, text string"), "part", "text")
    want = {(a, i) for a in asked for i, t in texts if len(a) >= 3 and t and a in t}
    assert got.columns == ["part", "id", "text"]
    assert sorted((x.part, x.id) for x in got.collect()) == sorted(want)


def test_rarest_run_costs_what_it_holds(spark):
    texts = spark.createDataFrame([(i, f"team number {i:04d}") for i in range(300)], "id int, text string")
    asked = spark.createDataFrame([("number 0123",), ("team number",), ("number 9",)], "part string")
    got = {x.part: (x.run, x.n) for x in grams.rarest(asked, grams.runs(texts, "text"), "part").collect()}
    assert got["number 0123"] == ("123", 1) and got["team number"][1] == 300 and "number 9" not in got


def test_doubtful_names_stay_unresolved(spark):
    dim = spark.createDataFrame([(1, "Royal Town", "RT"), (2, "royal town", "X"), (3, "Old Royal Town", "RT"), (4, "City", "C"), (5, "City", "D"), (6, None, None), (7, "Newcity Green", "NG")], "id int, name string, short string")
    asked = spark.createDataFrame([(x,) for x in ("Royal Town", "ROYAL TOWN", "old royal", "RT", "NG", "City", "green", "royal", "ty", None, "Newcity Green", "C")], "name string")
    teams = {x["name"]: x["id"] for x in identity.team_matches(asked, dim).collect()}
    # as written: one; without case: two; part of one; short name of two; of one; as written: two, whatever the parts say
    assert teams == {"Royal Town": 1, "ROYAL TOWN": None, "old royal": 3, "RT": None, "NG": 7, "City": None, "green": 7, "royal": None, "ty": None, "Newcity Green": 7, "C": 4}
    players = {x["name"]: x["id"] for x in names.resolve_unambiguous(asked, dim.select("id", "name")).collect()}
    assert players == {"Royal Town": 1, "ROYAL TOWN": None, "old royal": 3, "RT": None, "NG": None, "City": None, "green": 7, "royal": None, "ty": None, "Newcity Green": 7, "C": None, None: None}


def ends_of(spark, links):
    rows = names.chain_ends(spark.createDataFrame(links, "from_id int, to_id int")).collect()
    return {x.from_id: (x.to_id, x.hops, x.refused) for x in rows}


def test_chains_end_where_they_should(spark):
    links = [(i, i + 1) for i in range(1, 11)] + [(50, 11), (60, 60), (None, 3), (70, None), (1, 2)]
    got = ends_of(spark, links)
    assert got == {i: (11, 11 - i, None) for i in range(1, 11)} | {50: (11, 1, None)}
    ring = [(100, 101), (101, 102), (102, 100), (99, 100), (5, 6)]
    assert ends_of(spark, ring) == {k: (None, None, "cycle") for k in (99, 100, 101, 102)} | {5: (6, 1, None)}
    assert ends_of(spark, [(1, 2), (2, 3), (2, 4), (3, 9)]) == {1: (2, 1, None), 2: (None, None, "fork"), 3: (9, 1, None)}
    assert ends_of(spark, []) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 31, 32, 33, 200])
def test_long_chains_and_cycles_are_told_apart(spark, n):
    assert ends_of(spark, [(i, i + 1) for i in range(n)])[0] == (n, n, None)
    if n > 1:
        assert all(v == (None, None, "cycle") for v in ends_of(spark, [(i, (i + 1) % n) for i in range(n)]).values())


def test_merges_reach_every_table(spark):
    dim = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    played = spark.createDataFrame([(1, "m", 5), (2, "m", 4), (4, "m", 1), (None, "m", 0)], "player int, match string, runs int")
    merged = spark.createDataFrame([(1, 2), (2, 3)], "from_id int, to_id int")
    left, out = names.merge_everywhere(dim, {"played": (played, ["player"], ["player", "match"]), "all": (played, ["player"], [])}, merged)
    assert sorted(x.id for x in left.collect()) == [3, 4, 5]
    assert sorted(map(tuple, out["played"].collect()), key=str) == [(3, "m", 4), (4, "m", 1), (None, "m", 0)]
    assert out["all"].count() == 4 and out["all"].columns == played.columns
    with pytest.raises(ValueError, match="cycle"):
        names.merge_ids(played, "player", spark.createDataFrame([(1, 2), (2, 1)], "from_id int, to_id int"))
    with pytest.raises(ValueError, match="fork"):
        names.merge_ids(played, "player", spark.createDataFrame([(1, 2), (1, 3)], "from_id int, to_id int"))


def test_one_changed_cell_is_found(spark):
    a = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("s"))
    b = a.withColumn("s", F.when(F.col("k") == 3, F.lit("3")).otherwise(F.col("s"))).select("s", F.col("v").cast("int").alias("v"), "k").repartition(7)
    assert [tuple(x) for x in digests.differences(a, b, ["k"]).collect()] == [(3, "changed", ["s"])]
    assert digests.differences(a, a.repartition(9), ["k"]).count() == 0
    x, y = (digests.leaves(t, ["k"], ["k", "s", "v"]) for t in (a, a.repartition(9)))
    assert digests.root(x).collect() == digests.root(y).collect() and digests.unequal_buckets(x, y) == []


def test_differences_of_every_kind(spark):
    schema = "k int, l string, v string"
    a = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "c", None), (4, "d", "x"), (4, "d", "x"), (5, "e", "x"), (6, "f", "x"), (7, "g", "y")], schema)
    b = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "c", ""), (4, "d", "x"), (5, "e", "x"), (5, "e", "z"), (8, "h", "x"), (7, "g", "y")], schema)
    got = {x.k: (x.l, x.kind, x.columns) for x in digests.differences(a, b, ["k", "l"]).collect()}
    assert got == {2: (None, "changed", ["v"]), 3: ("c", "changed", ["v"]), 4: ("d", "repeated", []), 5: ("e", "repeated", []), 6: ("f", "missing", []), 8: ("h", "extra", [])}
    empty = spark.createDataFrame([], schema)
    assert digests.differences(a, empty, ["k", "l"]).where("kind <> 'missing'").count() == 0
    assert digests.differences(empty, empty, ["k", "l"]).count() == 0
    moved = [(1, None, "x"), (2, "x", None)]  # a hash that passes over nulls takes these for the same
    assert digests.differences(spark.createDataFrame(moved, schema), spark.createDataFrame([(1, "x", None), (2, None, "x")], schema), ["k"]).count() == 2


def test_many_unequal_buckets(spark):
    a = spark.range(20_000).withColumn("v", F.lit(1))
    assert digests.differences(a, a.withColumn("v", F.lit(2)), ["id"]).where("kind = 'changed' and columns = array('v')").count() == 20_000


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_rows_of_equal_keys_arent_shuffled(spark):
    texts = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(i)), 512) for i in range(4)])  # 512 bytes that don't compress
    a = shared.staged(spark.range(20_000).withColumn("text", texts), "wide")
    b = a.withColumn("text", F.when(F.col("id") % 200 == 7, F.lit("x")).otherwise(F.col("text"))).repartition(3, "text")
    b = shared.staged(b, "wide")
    before = shuffled(spark)
    got = digests.differences(a, b, ["id"], bits=4)  # as in large tables, each bucket holds one of the 100 keys that differ
    assert {tuple(x) for x in got.select("id", "kind", F.concat_ws(",", "columns")).collect()} == {(i, "changed", "text") for i in range(7, 20_000, 200)}
    assert shuffled(spark) - before < 2_000_000  # two sides of 10 MB


@pytest.mark.parametrize("most", [0, 1, digests.MOST_KEYS])
def test_differences_equal_plain_comparison(spark, most, monkeypatch):
    rng, heavy, plain = random.Random(3), [], digests._heavy
    monkeypatch.setattr(digests, "_heavy", lambda *x: heavy.extend(plain(*x)) or heavy)
    hot = [(None, "h", "r"), (None, "h", None), (5000, None, "r")]
    a = [(k, rng.choice(["p", None]), rng.choice(["v", "w", None])) for k in range(300)] + hot[:2] * 3000 + hot[2:] * 2000 + [(6000, "z", "r")] * 2 + [(6001, "z", "r")]
    b = [(k, l, rng.choice(["v", v, v, v])) for k, l, v in a[:290]] + hot[:2] * 2999 + hot[1:2] * 2 + hot[2:] * 2000 + [(6000, "z", "s")] * 2 + [(6001, "z", "r")] * 3 + [(7000, None, None)]
    rows = [Counter((x[:2], x[2]) for x in t) for t in (a, b)]
    of = [{k: sorted((str(v), n) for (q, v), n in c.items() if q == k) for k in {q for q, _ in c}} for c in rows]
    kind = lambda k: "missing" if k not in of[1] else "extra" if k not in of[0] else "repeated" if any(sum(n for _, n in o[k]) > 1 for o in of) else "changed"
    want = {(*k, kind(k)) for k in of[0].keys() | of[1].keys() if of[0].get(k) != of[1].get(k)}
    x, y = (spark.createDataFrame(t, "k int, l string, v string") for t in (a, b))
    got = digests.differences(x, y.select("v", "l", "k").repartition(3), ["k", "l"], bits=8, most=most).collect()
    assert sorted(((d.k, d.l, d.kind) for d in got), key=str) == sorted(want, key=str) and heavy
    assert all(d["columns"] == (["v"] if d.kind == "changed" else []) for d in got) and {d.kind for d in got} == {"missing", "extra", "changed", "repeated"}


def test_columns_keep_their_contents_whatever_their_names(spark):
    a = spark.createDataFrame([(1, 1, "a", 5, 0), (2, 2, None, 6, 0)], "key int, _key int, row string, sign int, _side int")
    b = a.withColumn("_key", F.when(F.col("key") == 2, 3).otherwise(F.col("_key"))).withColumn("_side", F.when(F.col("key") == 1, 1).otherwise(0))
    assert sorted(map(tuple, digests.differences(a, b, ["key"]).collect())) == [(1, "changed", ["_side"]), (2, "changed", ["_key"])]


def test_shuffle_files_go_with_the_write(spark):
    dirs = [Path(d.getPath()) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    dealt, until = shared.staged(spark.range(1000).repartition("id"), "dealt"), time.time() + 5
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(setting) == "false" and dealt.count() == 1000


def test_sync_checks_fail_for_their_own_reason(spark):
    m = spark.createDataFrame([("a", "x"), ("b", None)], "match_id string, venue string")
    d = spark.createDataFrame([("a", 1), ("b", 2)], "match_id string, runs int")
    run = lambda target, **more: {(x.category, x.check): x.status for x in quality.sync_checks({"m": m, "d": d}, target, {"m": ["match_id"], "d": ["match_id", "runs"]}, **more).collect()}
    more = dict(links={"m": ["venue"]}, references={"d": ("match_id", "m")}, covered={"d": ("match_id", "m")}, golden={"m": spark.createDataFrame([("b", None)], "match_id string, venue string")})
    assert set(run({"m": m, "d": d}, **more).values()) == {"PASS"}
    got = run({"m": m.where("match_id = 'a'"), "d": d}, **more)
    assert {k for k, v in got.items() if v == "FAIL"} == {("m", "rows"), ("m", "differing"), ("d", "orphans of m"), ("m", "golden rows")}
    got = run({"m": m.withColumn("venue", F.lit(None).cast("string")), "d": d.where("runs = 1")}, **more)
    assert {k for k, v in got.items() if v == "FAIL"} == {("m", "differing"), ("m", "filled venue"), ("d", "rows"), ("d", "differing"), ("d", "covers m")}

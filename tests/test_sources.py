"""Archives, counted preparation, ranks filled by ranges, tables that refer to one another, official careers."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from wicketflow.operators import keys, merges, records
from wicketflow.sources import archives, matches


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        for i in range(20):
            z.writestr(f"d/{i}.json", "x" * 1000)
        z.writestr("readme.txt", "no")
    with zipfile.ZipFile(tmp_path / "in" / "deep" / "b.zip", "w"):
        pass
    (tmp_path / "in" / "c.txt").write_text("no archive")
    rows = archives.read_members(spark, str(tmp_path / "in"), ending=".json", task_bytes=5000)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    assert sorted(x.member for x in rows.collect()) == sorted(f"d/{i}.json" for i in range(20))
    assert rows.agg(F.sum(F.length("content"))).first()[0] == 20_000
    assert archives.read_members(spark, f"file://{tmp_path}/in/a.zip").count() == 21
    (tmp_path / "in" / "broken.zip").write_bytes(b"PK not really")
    with pytest.raises(Exception, match="(?i)zip"):
        archives.read_members(spark, str(tmp_path / "in")).count()


def test_archives_come_back_as_written(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.json", f"é{i}") for i in range(50)], "name string, body string").repartition(3)
    made = archives.write_archives(rows, "name", "body", f"{tmp_path}/out").collect()
    assert sum(x.members for x in made) == 50 and len(list((tmp_path / "out").iterdir())) == len(made)
    back = archives.read_members(spark, f"{tmp_path}/out").select("member", F.col("content").cast("string").alias("body"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert archives.write_archives(rows.limit(0), "name", "body", f"{tmp_path}/none").count() == 0


def test_preparation_counts_what_it_did(spark, tmp_path):
    doc = lambda **info: json.dumps({"info": info, "innings": []})
    lines = [("x/1.json", doc(gender="male", match_type="T20", team_type="international")), ("2.json", doc(gender="male", match_type="T20", team_type="club")), ("3.json", doc(gender="female", match_type="T20")), ("4.json", '{"info": {"gender": "ma'), ("5.json", ""), ("6.json", None), ("7.json", "[]"), ("8.json", '{"meta": 1}'), ("9.json", doc(match_type="ODI"))]
    df = spark.createDataFrame(lines, "file string, value string")
    assert matches.write_prepared(df, f"{tmp_path}/a") == {"total": 9, "malformed": 5, "filtered_out": 2, "format_remapped": 1, "written": 2}
    got = {x.match_id: (x.meta.original_match_type, x.meta.prepared_format) for x in spark.read.json(f"{tmp_path}/a").collect()}
    assert got == {"1": ("T20", "T20I"), "2": ("T20", "T20")}
    assert matches.write_prepared(df, f"{tmp_path}/b", gender="all", remap=False) == {"total": 9, "malformed": 5, "filtered_out": 0, "format_remapped": 0, "written": 4}


def test_ranks_are_filled_across_ranges(spark):
    rows = [("hot", i, str(i) if i % 50 == 7 else "=" if i % 2 else None) for i in range(400)] + [(None, 1, "3"), (None, 2, "="), ("b", 1, "="), ("b", 2, "x"), ("b", 3, "9")]
    got = {(x["list"], x["at"]): x["rank"] for x in merges.shared_rank(spark.createDataFrame(rows, "list string, at int, rank string").repartition(5), "at").collect()}
    want = {("hot", i): None if i < 7 else (i - 7) // 50 * 50 + 7 for i in range(400)} | {(None, 1): 3, (None, 2): 3, ("b", 1): None, ("b", 2): None, ("b", 3): 9}
    assert got == want


REFS = [keys.Reference("c", "b_id", "b"), keys.Reference("b", "a_id", "a"), keys.Reference("c", "v_id", "v", required=False)]


def small(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {"c": make([(1, 10, 7), (2, 11, 8), (3, 12, None), (4, None, 7), (5, 99, 7)], "id int, b_id int, v_id int"), "b": make([(10, 100), (11, 101), (12, 102)], "id int, a_id int"), "a": make([(100,), (101,), (102,)], "id int"), "v": make([(7,), (8,)], "id int")}


def rows_of(tables):
    return {k: sorted(map(tuple, v.collect()), key=str) for k, v in tables.items()}


def test_references_are_walked_parents_first(spark):
    assert keys.in_order(["c", "b", "a", "v"], REFS) in (["a", "v", "b", "c"],)
    with pytest.raises(ValueError, match="go round"):
        keys.in_order(["a", "b", "c"], [keys.Reference("a", "x", "b"), keys.Reference("b", "x", "a")])
    with pytest.raises(ValueError, match="go round"):
        keys.in_order(["a"], [keys.Reference("a", "x", "a")])


def test_one_call_remaps_three_levels(spark):
    ids = {"a": spark.createDataFrame([(100, 1), (101, 2)], "old_id int, new_id int"), "v": spark.createDataFrame([(7, 70)], "old_id int, new_id int")}
    out, rejects = keys.remapped(small(spark), REFS, ids)
    assert rows_of(out) == {"a": [(1,), (2,)], "v": [(70,)], "b": [(10, 1), (11, 2)], "c": [(1, 10, 70), (2, 11, None)]}
    got = rows_of(rejects)
    assert got["a"] == [(102, "no id")] and got["b"] == [(12, 102, "no a: a_id")] and got["v"] == [(8, "no id")]
    assert got["c"] == [(3, 12, None, "no b: b_id"), (4, None, 7, "no b: b_id"), (5, 99, 7, "no b: b_id")]


def test_one_call_purges_three_levels(spark):
    gone = {"a": spark.createDataFrame([(100,), (100,)], "id int"), "v": spark.createDataFrame([(8,)], "id int"), "c": spark.createDataFrame([(3,)], "id int")}
    out, lost = keys.purged(small(spark), REFS, gone)
    assert rows_of(out) == {"a": [(101,), (102,)], "v": [(7,)], "b": [(11, 101), (12, 102)], "c": [(2, 11, None), (4, None, 7), (5, 99, 7)]}
    assert rows_of(lost) == {"a": [(100, 0)], "v": [(8, 0)], "b": [(10, 100, 1)], "c": [(1, 10, 7, 2), (3, 12, None, 0)]}


def test_names_become_ids_or_reasons(spark):
    dim = spark.createDataFrame([("x", 1)], "name string, id int")
    rows = spark.createDataFrame([(1, "x", "x"), (2, "y", "x"), (3, "x", "y"), (4, None, None)], "k int, team string, venue string")
    good, bad = keys.with_ids(rows, {"team": (dim, True), "venue": (dim, False)})
    assert sorted((x.k, x.team_id, x.venue_id) for x in good.collect()) == [(1, 1, 1), (3, 1, None)]
    assert sorted((x.k, x.reason) for x in bad.collect()) == [(2, "team"), (4, "team")]
    kinds = spark.createDataFrame([(1, 5, 3), (None, 5, 3), (0, 0, 3), (None, None, None), (0, None, 0)], "i int, r int, w int")
    assert [x[0] for x in kinds.select(keys.win_type(F.col("i"), F.col("r"), F.col("w"))).collect()] == ["innings", "runs", "wickets", None, None]


def documents(spark, balls, **info):
    doc = {"match_id": "1", "info": {"match_type": "T20", "teams": ["A", "B"], "players": {"A": ["x", "y", "z"], "B": ["u", "w"]}} | info, "innings": [{"team": "A", "overs": [{"over": o, "deliveries": d} for o, d in balls]}]}
    return spark.createDataFrame([(json.dumps(doc),)], "value string").select(F.from_json("value", matches._DDL).alias("d")).select("d.*")


def ball(runs=0, total=None, batter="x", bowler="u", other="y", **more):
    return {"batter": batter, "bowler": bowler, "non_striker": other, "runs": {"batter": runs, "extras": 0, "total": runs if total is None else total}} | more


def test_official_careers_take_all_wickets_of_a_ball(spark):
    both = [{"player_out": "x", "kind": "caught"}, {"player_out": "y", "kind": "stumped"}]
    docs = documents(spark, [(0, [ball(4), ball(0, 1, extras={"wides": 1}), ball(0, wickets=both), ball(6, batter="z"), ball(0, batter="z"), ball(0, batter="z"), ball(0, batter="z")]), (16, [ball(0, 2, batter="z", bowler="w", extras={"legbyes": 2})] * 6), (17, [ball(0, batter="z", bowler="w", wickets=[{"player_out": "z", "kind": "run out"}])])])
    lines = records.official_lines(docs)
    bat = {x.player: (x.matches, x.innings, x.not_outs, x.runs, x.balls, x.dots) for x in records.batting_careers(lines).collect()}
    assert bat == {"x": (1, 1, 0, 4, 2, 1), "y": (1, 1, 0, 0, 0, 0), "z": (1, 1, 0, 6, 11, 4), "u": (1, 0, 0, 0, 0, 0), "w": (1, 0, 0, 0, 0, 0)}
    bowl = {x.player: (x.balls, x.conceded, x.wickets, x.maidens, x.dots, x.boundaries, x.powerplay_wickets, x.death_balls, x.best_figures) for x in records.bowling_careers(lines).collect()}
    assert bowl == {"u": (6, 11, 2, 0, 4, 2, 2, 0, "2/11"), "w": (7, 0, 0, 1, 1, 0, 0, 7, "0/0")}


def test_official_careers_by_ids(spark):
    docs = documents(spark, [(0, [ball(1), ball(2, batter="X "), ball(3, batter="nobody")])])
    known = spark.createDataFrame([("x", "id1"), ("u", "id2")], "k string, id string")
    lines = records.official_lines(docs, known)
    assert {(x.player, x.runs) for x in records.batting_careers(lines).collect()} == {("id1", 3), ("id2", 0)}
    assert {x["name"] for x in records.unresolved_names(lines).collect()} == {"y", "z", "w", "nobody"}
    empty = documents(spark, []).withColumn("innings", F.lit(None).cast(docs.schema["innings"].dataType))
    assert records.official_bowling(empty).count() == 0 and records.official_batting(empty).where("innings > 0").count() == 0


def test_staged_tables_can_be_removed(spark):
    from wicketflow.sources import shared

    a, b = shared.staged(spark.range(3), "a"), shared.staged(spark.range(4), "b")
    assert shared.drop_staged(spark, b) >= 1 and b.count() == 4
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(a.inputFiles()[0])
    assert shared.drop_staged(spark) == 1 and shared.drop_staged(spark) == 0

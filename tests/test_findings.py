"""Tests of review findings: names in doubt, tables derived once, files written by tasks, and the changed queries against their oracles."""

from __future__ import annotations

import json

import duckdb
import pytest

from wicketflow import registry
from wicketflow.plans import adapter, record_queries
from wicketflow.sources import matches, sinks

SF = "/root/testdata/sf0.001"
CHANGED = "copy_differences copy_tables_verified duplicate_documents fn_match_id impact_rollup match_live_entities official_by_id percent_rank_season prepare_counts remap_references resolve_player_unambiguous scan_directory_limited scan_file_batch scan_match_json season_players self_initial_expansion verify_idempotency".split()


@pytest.mark.parametrize("name", CHANGED)
def test_changed_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in "nation supplier customer orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def norm(rows):
        fix = lambda v: float(round(v, 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return sorted((tuple(fix(v) for v in row) for row in rows), key=repr)

    assert norm(got.select(*columns).collect()) == norm(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_names_in_doubt_are_answered(spark):
    got = {x["k"]: x["id"] for x in registry.QUERIES["resolve_player_unambiguous"](spark, "/root/testdata/sf0.001").collect()}
    names = adapter.Tables(spark, "/root/testdata/sf0.001").raw("supplier").collect()
    assert set(got) == {x["s_name"].lower() for x in names} | {"shared"}  # also those of which nobody can say whom they mean
    assert {k for k, v in got.items() if v is None} == {x["s_name"].lower() for x in names if x["s_suppkey"] % 10 == 5 or x["s_suppkey"] % 30 == 0} | {"shared"}


def test_a_file_a_row_without_renames(spark, tmp_path):
    rows = spark.createDataFrame([(f"folder=m{i % 3}/m{i}.json", json.dumps({"match_id": f"m{i}", "info": {"city": "é" * (i % 5)}})) for i in range(30)], "name string, content string").repartition(4)
    assert sinks.write_files(rows, f"{tmp_path}/out") == 30 and sinks.write_files(rows.limit(0), f"{tmp_path}/none") == 0
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(f"m{i}.json" for i in range(30))  # nothing but the files
    docs = matches.read_matches(spark, f"{tmp_path}/out")
    assert {(x["match_id"], x["city"]) for x in docs.select("match_id", "info.city").collect()} == {(f"m{i}", "é" * (i % 5)) for i in range(30)}
    first = matches.first_files(docs, 3)
    assert sorted(x["match_id"] for x in first.collect()) == ["m0", "m12", "m15"]


def test_floors_by_whole_division(spark):
    sql = "SELECT " + ", ".join(f"CAST(FLOOR(k/{n}.0) AS INT)" for n in (4, 12, 24, 60)) + " FROM VALUES (-61), (-60), (-1), (0), (59), (60), (119), (CAST(NULL AS INT)) AS t(k)"
    assert "DIV" in adapter._whole(sql) and spark.sql(sql).collect() == spark.sql(adapter._whole(sql)).collect()
    assert "FLOOR" not in adapter._whole(adapter.CTES)


def test_stored_tables_are_derived_once(spark):
    t = adapter.Tables(spark, "/root/testdata/sf0.001")
    s = t.stored()
    assert s.stored() is s and s.matches.inputFiles() and all("lineitem" not in f for x in (s.matches, s.deliveries) for f in x.inputFiles())
    for name in ("matches", "deliveries"):
        a, b = getattr(t, name), getattr(s, name)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name", ["verify_idempotency", "copy_differences"])
def test_no_fixed_number_of_tasks_deals_the_rows(spark, monkeypatch, name):
    frame, asked = type(spark.range(1)), []
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: asked.append(a) or plain(self, *a))
    assert registry.QUERIES[name](spark, SF).count() > 0
    assert len(asked) >= 2 and not any(isinstance(x, int) for a in asked for x in a)


@pytest.mark.parametrize("name", ["self_initial_expansion", "official_by_id", "match_live_entities", "remap_references", "verify_sync", "percent_rank_season", "season_impact", "season_players", "impact_rollup"])
def test_balls_are_derived_once(spark, name):
    assert not [f for f in registry.QUERIES[name](spark, SF).inputFiles() if "lineitem" in f or "/batting-" in f or "/bowling-" in f]


def test_documents_are_written_compressed(spark, tmp_path):
    t = adapter.Tables(spark, SF)
    assert {f.rpartition(".")[2] for f in t.spark.read.text(record_queries.rich(t)).inputFiles()} == {"gz"}
    lines = spark.createDataFrame([("a.json", json.dumps({"info": {"gender": "male", "match_type": "ODI"}})), ("b.json", "{")], "file string, value string")
    assert matches.write_prepared(lines, f"{tmp_path}/out") == {"total": 2, "malformed": 1, "filtered_out": 0, "format_remapped": 0, "written": 1}
    assert {f.rpartition(".")[2] for f in spark.read.json(f"{tmp_path}/out").inputFiles()} == {"gz"}


def test_lines_of_a_ranking_come_from_one_derivation(spark, monkeypatch):
    names, plain = [], adapter.staged
    monkeypatch.setattr(adapter, "staged", lambda df, name: names.append(name) or plain(df, name))
    registry.QUERIES["rank_allrounder"](spark, SF).collect()
    assert sorted(names) == ["batting", "bowling", "deliveries"]

"""The scoring rules on tiny tables, and registered queries against their oracles."""

from __future__ import annotations

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wicketflow import registry
from wicketflow.functions import rules as r
from wicketflow.operators import careers, innings, names, quality, scores, teams
from wicketflow.sources import matches, sinks

COLUMNS = (
    "match_id string, match_date date, format string, venue string, innings_number int, over_number int, ball_in_over int, team_a string, team_b string, batting_team string, bowling_team string, batter string, non_striker string, bowler string,"
    " runs_batter int, runs_extras int, runs_total int, extra_type string, extras_wides int, extras_noballs int, non_boundary boolean, is_wicket boolean, wicket_type string, dismissed_player string, fielder string"
)


def ball(n, runs=0, extras=0, kind=None, wides=0, noballs=0, out=None, who=None, non_boundary=False, over=0, batter="Batter", fmt="T20"):
    return ("m", datetime.date(2024, 1, 1), fmt, "V", 1, over, n, "A", "B", "A", "B", batter, "Partner", "Bowler", runs, extras, runs + extras, kind, wides, noballs, non_boundary, out is not None, out, who, None)


@pytest.fixture(scope="module")
def six(spark):
    """Wide, no-ball four, byes, leg byes, run-out of the partner, bowled."""
    rows = [ball(1, 0, 2, "wide", wides=2), ball(2, 4, 1, "noball", noballs=1), ball(3, 0, 3, "bye"), ball(4, 0, 2, "legbye"), ball(5, out="run out", who="Partner"), ball(6, out="bowled", who="Batter")]
    return spark.createDataFrame(rows, COLUMNS)


def test_six_balls(six):
    bat = {x["player"]: x for x in innings.batting_lines(six).collect()}
    assert (bat["Batter"]["runs"], bat["Batter"]["balls"], bat["Batter"]["dots"], bat["Batter"]["out"]) == (4, 5, 2, True)
    assert bat["Partner"]["out"] and bat["Partner"]["balls"] == 0
    bowl = innings.bowling_lines(six).first()
    assert (bowl["balls"], bowl["conceded"], bowl["wickets"], bowl["dots"]) == (4, 7, 1, 2)
    assert careers.career_bowling(innings.bowling_lines(six)).first()["economy"] == 10.5
    pair = careers.matchups(six, least=1).first()
    assert (pair["balls"], pair["dismissals"]) == (5, 1)
    card = {x["player"]: x for x in innings.dismissal_text(innings.scorecard_batting(six)).collect()}
    assert card["Batter"]["position"] == 1 and card["Partner"]["position"] == 2 and card["Batter"]["dismissal"] == "b Bowler"


def test_all_run_four_is_no_boundary(spark):
    d = spark.createDataFrame([ball(1, 4, non_boundary=True)], COLUMNS)
    assert innings.batting_lines(d).first()["fours"] == 0 and innings.bowling_lines(d).first()["boundaries"] == 0


def test_long_overs_only_in_multi_day_matches(spark):
    d = spark.createDataFrame([ball(1, over=125), ball(1, over=125, fmt="Test"), ball(1, batter=None)], COLUMNS)
    assert [x["format"] for x in innings.validate(d).collect()] == ["Test"]
    assert sorted(x["reason"] for x in innings.rejected(d).collect()) == ["no batter", "over beyond 100"]


def test_null_extras_and_phases(spark):
    d = spark.createDataFrame([ball(1, 3)], COLUMNS).withColumn("extras_wides", F.lit(None).cast("int"))
    assert d.select(r.bowler_runs().alias("x")).first()["x"] == 3
    rows = spark.createDataFrame([("T20", 5, "powerplay"), ("T20", 6, "middle"), ("ODI", 10, "middle"), ("ODI", 40, "death"), ("Test", 3, "general"), ("?", 15, "death")], "format string, over_number int, want string")
    assert rows.where(r.phase() != F.col("want")).count() == 0


def test_ties_are_no_losses(spark):
    m = spark.createDataFrame([("1", "T20", "V", "A", "B", 10, 10, 3, None, "tie"), ("2", "T20", "V", "A", "B", 5, 9, 3, "B", "win")], "match_id string, format string, venue string, team_a string, team_b string, first_runs long, second_runs long, second_wickets long, winner string, result_type string")
    rows = {x["team"]: x for x in teams.team_records(teams.perspectives(m)).collect()}
    assert (rows["A"]["losses"], rows["A"]["ties"], rows["B"]["losses"], rows["B"]["ties"]) == (1, 1, 0, 1)
    perf = {x["team"]: x for x in teams.team_performance(teams.perspectives(m)).collect()}
    assert perf["A"]["defend_pct"] == 0 and perf["B"]["chase_pct"] == 50
    assert m.select(teams.result_text().alias("t")).collect()[1]["t"] == "B won by 7 wickets"


def test_average_tie_percentile(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("b", 5.0)], "k string, v double")
    d = d.select("*", F.row_number().over(scores.Window.orderBy("k", "v")).alias("row"))
    got = sorted((x["k"], x["v"] or 0, x["v_rank"]) for x in scores.percentiles(d, ["row"], ["k"], {"v": (F.col("v"), False)}).collect())
    assert got[0] == ("a", 0, None) and abs(got[1][2] - 100 / 3) < 1e-9 and abs(got[2][2] - 250 / 3) < 1e-9 and got[4][2] == 50


def test_names(spark):
    dim = spark.createDataFrame([("1", "Ann Lee"), ("2", "Bob Ray"), ("3", "BOB RAY"), ("4", "Catherine Zed")], "id string, name string")
    asked = spark.createDataFrame([("Ann Lee",), ("ann  lee",), ("bob ray",), ("zed",), ("nobody",), (None,)], "name string")
    got = {x["name"]: x["id"] for x in names.resolve_unambiguous(asked, dim).collect()}
    assert got == {"Ann Lee": "1", "ann  lee": "1", "bob ray": None, "zed": "4", "nobody": None, None: None}
    editions = spark.createDataFrame([("1", "Champions World Cup", "2023"), ("2", "Champions World Cup", "2019"), ("3", "Other League", "2023")], "id string, name string, season string")
    found = names.search(editions, spark.createDataFrame([("CWC 2023",), ("cwc",), ("CWC 23",), ("someone",)], "query string")).collect()
    found = sorted((x["query"], x["n"], x["id"], x["score"]) for x in found)
    # a query that names a season finds its editions only; else the later season comes first
    assert found == [("CWC 2023", 1, "1", 120), ("CWC 23", 1, "1", 120), ("cwc", 1, "1", 95), ("cwc", 2, "2", 95)]
    texts = spark.range(1).select(names.overs_to_balls(F.lit("83.1")).alias("a"), names.score_value(F.lit("112*")).alias("b"), names.balls_to_overs(F.lit(499)).alias("c"), names.parse_int(F.lit("1,234")).alias("d")).first()
    assert tuple(texts) == (499, 112, "83.1", 1234)


def test_clamp(spark):
    row = quality.clamp(spark.createDataFrame([(4, 100, -3), (4, 100, 9)], "innings int, runs int, not_outs int")).collect()
    assert (row[0]["not_outs"], row[0]["average"], row[1]["not_outs"], row[1]["average"]) == (0, 25.0, 4, None)


def test_malformed_documents_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"info": {"match_type": "T20", "teams": ["A", "B"], "dates": ["2024-01-01"]}, "innings": [{"team": "B", "overs": [{"over": 0, "deliveries": [{"batter": "x", "bowler": "y", "runs": {"batter": 1, "extras": 0, "total": 1}, "wickets": [{"player_out": "x", "kind": "bowled"}, {"player_out": "z", "kind": "run out"}]}]}]}]}')
    (tmp_path / "b.json").write_text("{ not json")
    docs = matches.read_matches(spark, str(tmp_path)).cache()
    assert docs.count() == 2 and docs.where("_corrupt is not null").count() == 1
    row = matches.flatten(docs.where("_corrupt is null")).first()
    assert (row["match_id"], row["bowling_team"], row["wicket_type"], len(row["wickets"]), row["extras_wides"]) == ("a", "A", "bowled", 2, 0)
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "a.json", "a.json")
    assert matches.read_zip(spark, str(tmp_path / "z.zip")).select("match_id").first()["match_id"] == "a"


def test_unseen_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    assert [x["k"] for x in sinks.unseen(df, df.where("k = 1"), ["k"]).collect()] == [2]


def test_table_over_jdbc(spark):
    """Appends go on top of what is there; truncate empties the table first."""
    url, driver = "jdbc:derby:memory:wicketflow;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    read = lambda: sorted((x["k"], x["v"]) for x in spark.read.jdbc(url, "t", properties=driver).toDF("k", "v").collect())
    sinks.write_table(df.where("k < 3"), url, "t", batch=1, **driver)
    sinks.write_table(df.where("k = 3"), url, "t", **driver)
    assert read() == [(1, "a"), (2, "b"), (3, None)]
    sinks.write_table(df.where("k = 2"), url, "t", mode="overwrite", truncate=True, **driver)
    assert read() == [(2, "b")]


def test_percentiles_equal_pandas(spark):
    """Many rows in few ranges: ties, nulls, the least as the best, one value alone."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"id": range(500), "k": rng.choice(["a", "b"], 500), "x": rng.integers(0, 40, 500).astype(float)})
    rows.loc[rng.random(500) < 0.1, "x"] = np.nan
    rows = pd.concat([rows, pd.DataFrame({"id": [500, 501], "k": ["c", "d"], "x": [3.0, np.nan]})])
    df = spark.createDataFrame(rows).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = scores.percentiles(df, ["id"], ["k"], {"up": (F.col("x"), False), "down": (F.col("x"), True)}, alone=50.0, ranges=7).toPandas().set_index("id")
    for name, up in (("up_rank", True), ("down_rank", False)):
        want = rows.set_index("id").groupby("k")["x"].rank(pct=True, ascending=up) * 100
        want[500] = 50.0
        assert np.allclose(got[name].reindex(want.index), want, equal_nan=True)
    places = scores.numbered(df.where("x is not null"), ["k"], [F.col("x"), F.col("id")], ranges=5).toPandas()
    for _, part in places.groupby("k"):
        assert part.sort_values(["x", "id"])["n"].tolist() == list(range(1, len(part) + 1))


def test_search_terms_and_parts(spark):
    from wicketflow.operators import identity

    asked = spark.createDataFrame([("cwc 23",), ("cup 2019 x",), ("old 61",), ("",)], "q string")
    assert [tuple(x) for x in asked.select(*identity.query_terms(F.col("q"))).collect()] == [("cwc", "2023"), ("cup x", "2019"), ("old", "1961"), ("", None)]
    dim = spark.createDataFrame([(1, "Royal Town", "RT"), (2, "royal city", "RC"), (3, "City", "C"), (4, "CITY", "C2")], "id int, name string, short string")
    names_ = spark.createDataFrame([("Royal Town",), ("RC",), ("ROYAL CITY",), ("Royal",), ("al to",), ("city",), ("zz",)], "name string")
    got = {x["name"]: x["id"] for x in identity.team_matches(names_, dim).collect()}
    assert got == {"Royal Town": 1, "RC": 2, "ROYAL CITY": 2, "Royal": None, "al to": 1, "city": None, "zz": None}


def test_scores_of_teams(spark):
    from wicketflow.operators import identity

    rows = [("A", "B", [("b inning 1", 5, 1, 2.0), ("A inning 1", 9, None, None), ("a inning 2", 3, 2, 1.1)]), ("A", "B", [("first", 7, 1, None), ("second", None, 1, 1.0), ("third", 8, None, 2.0)]), ("A", "B", None)]
    d = spark.createDataFrame(rows, "a string, b string, s array<struct<inning:string,r:int,w:int,o:double>>")
    got = [tuple(x) for x in d.select(*identity.scores_by_team(F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert got == [("9 & 3/2 (1.1 ov)", "5/1 (2.0 ov)"), ("7/1", "8 (2.0 ov)"), (None, None)]


def test_official_careers_count_named_players(spark):
    from wicketflow.operators import records

    info = '"info":{"match_type":"ODI","dates":["2024-01-01"],"teams":["A","B"],"players":{"A":["x","y","z"],"B":["u","w"]}}'
    balls = '{"batter":"x","bowler":"u","non_striker":"y","runs":{"batter":4,"extras":0,"total":4},"wickets":[{"player_out":"x","kind":"bowled"},{"player_out":"y","kind":"run out"}]}'
    doc = '{"match_id":"1",' + info + ',"innings":[{"team":"A","overs":[{"over":0,"deliveries":[' + balls + "]}]}]}"
    docs = spark.createDataFrame([(doc,)], "value string").select(F.from_json("value", matches._DDL).alias("d")).select("d.*")
    d = matches.flatten(docs)
    bat = {x["player"]: (x["matches"], x["innings"], x["not_outs"], x["runs"]) for x in records.official_batting(docs).collect()}
    assert bat["z"] == (1, 0, 0, 0) and bat["x"] == (1, 1, 0, 4) and bat["u"] == (1, 0, 0, 0)
    assert [(x["batter"], x["wickets"]) for x in records.official_matchups(d, 1).collect()] == [("x", 1)]
    assert records.official_bowling(docs).first()["best_figures"] == "1/4"


def test_prepared_documents(spark):
    rows = [("1", ("T20", "international", "male")), ("2", ("T20", "club", "male")), ("3", ("T20", "international", "female"))]
    docs = spark.createDataFrame(rows, "match_id string, info struct<match_type:string,team_type:string,gender:string>")
    got = {x["match_id"]: tuple(x["meta"]) for x in matches.prepared(docs).collect()}
    assert got == {"1": ("T20", "T20I"), "2": ("T20", "T20")} and matches.prepared(docs, gender="all").count() == 3


SOME = ["official_batting", "career_bowling_full", "season_impact", "rank_allrounder", "map_player_ids", "verify_sync", "stream_windows", "cumulative_innings", "scorecard_batting", "career_batting", "matchups", "team_performance", "venue_stats", "form_score", "impact_score", "audit_deliveries", "stream_dedupe", "flatten_deliveries"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "nation supplier customer orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def norm(rows):
        fix = lambda v: float(round(v, 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return sorted((tuple(fix(v) for v in row) for row in rows), key=repr)

    assert norm(got.select(*columns).collect()) == norm(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_query_is_registered_once():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(registry.QUERIES) <= set(entry.queries())

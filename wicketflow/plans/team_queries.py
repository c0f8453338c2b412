"""Registered queries over teams, matches and venues, with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wicketflow.operators import teams as o
from wicketflow.registry import query

TOT = """, mt AS (SELECT match_id, format, venue, team_a, team_b, CAST(sum(CASE WHEN innings_number = 1 THEN runs_total ELSE 0 END) AS BIGINT) AS first_runs, CAST(sum(CASE WHEN innings_number = 2 THEN runs_total ELSE 0 END) AS BIGINT) AS second_runs,
 count_if(innings_number = 1 AND is_wicket) AS first_wickets, count_if(innings_number = 2 AND is_wicket) AS second_wickets FROM flags GROUP BY ALL) """
SIDES = """, sides AS (SELECT match_id, match_date, format, venue, competition, season, match_number, toss_winner, toss_decision, winner, result_type, team_a AS team, team_b AS opponent, first_runs AS scored, second_runs AS allowed, false AS chased FROM matches
 UNION ALL SELECT match_id, match_date, format, venue, competition, season, match_number, toss_winner, toss_decision, winner, result_type, team_b, team_a, second_runs, first_runs, true FROM matches) """


def sides(t):
    return o.perspectives(t.matches)


def records(keys: str = "", where: str = "") -> str:
    keys = f"team{', ' + keys if keys else ''}"
    return SIDES + f"""SELECT *, wins * 100.0::DOUBLE / matches AS win_rate FROM (SELECT {keys}, count(*) AS matches, count_if(result_type = 'win' AND winner = team) AS wins, count_if(result_type = 'win' AND winner <> team) AS losses,
count_if(result_type = 'draw') AS draws, count_if(result_type = 'tie') AS ties, count_if(result_type IN ('no_result', 'abandoned')) AS no_results FROM sides {where} GROUP BY ALL)"""


RES = "CASE WHEN first_runs > second_runs THEN team_a WHEN second_runs > first_runs THEN team_b END AS winner"
query("team_match_results", TOT + f"SELECT *, {RES} FROM mt")(lambda t: o.match_results(o.match_totals(t.deliveries)).drop("win_type", "margin"))
query("match_results", TOT + f"""SELECT *, {RES}, CASE WHEN first_runs > second_runs THEN 'runs' WHEN second_runs > first_runs THEN 'wickets' ELSE 'tie' END AS win_type,
CASE WHEN first_runs > second_runs THEN first_runs - second_runs WHEN second_runs > first_runs THEN 10 - second_wickets END AS margin FROM mt""")(lambda t: o.match_results(o.match_totals(t.deliveries)))
query("join_innings_pair", TOT + "SELECT match_id, first_runs, second_runs FROM mt")(lambda t: o.match_totals(t.deliveries).select("match_id", "first_runs", "second_runs"))
query("proj_result_text", """SELECT match_id, CASE result_type WHEN 'win' THEN winner || ' won by ' || CASE WHEN winner = team_a THEN (first_runs - second_runs) || ' runs' ELSE (10 - second_wickets) || ' wickets' END WHEN 'draw' THEN 'Match drawn' WHEN 'tie' THEN 'Match tied' ELSE 'No result' END AS result FROM matches""")(
    lambda t: t.matches.select("match_id", o.result_text().alias("result"))
)
query("team_perspectives", SIDES + "SELECT match_id, team, opponent, scored, allowed, chased FROM sides")(lambda t: sides(t).select("match_id", "team", "opponent", "scored", "allowed", "chased"))
query("union_all_appearances", SIDES + "SELECT team, count(*) AS matches FROM sides GROUP BY ALL")(lambda t: t.matches.select(F.col("team_a").alias("team")).unionAll(t.matches.select("team_b")).groupBy("team").agg(F.count("*").alias("matches")))
query("union_distinct_participants", "SELECT competition, team_a AS team FROM matches UNION SELECT competition, team_b FROM matches")(lambda t: t.matches.select("competition", F.col("team_a").alias("team")).union(t.matches.select("competition", "team_b")).distinct())
query("team_performance_basic", records("format"))(lambda t: o.team_records(sides(t), "format"))
query("team_by_format", records("format", "WHERE team = 'Team1'"))(lambda t: o.team_records(sides(t).where("team = 'Team1'"), "format"))
query("team_by_year", records("year(match_date) AS year"))(lambda t: o.team_records(sides(t).withColumn("year", F.year("match_date").cast("long")), "year"))
query("team_trend", SIDES + "SELECT team, year(match_date) AS year, count_if(result_type = 'win' AND winner = team) * 100.0::DOUBLE / count(*) AS win_rate FROM sides GROUP BY ALL")(
    lambda t: o.team_records(sides(t).withColumn("year", F.year("match_date").cast("long")), "year").select("team", "year", "win_rate")
)
query("team_at_venue", records("venue"))(lambda t: o.team_records(sides(t), "venue"))
query("venue_team_performance", records("venue, format"))(lambda t: o.team_records(sides(t), "venue", "format"))
query("join_theta_either_team", records("venue", "WHERE venue = 'V3'"))(lambda t: o.team_records(sides(t).where("venue = 'V3'"), "venue"))
query("team_by_competition", records("competition, format"))(lambda t: o.team_records(sides(t), "competition", "format"))
PERF = SIDES + """, tp AS (SELECT *, runs / matches::DOUBLE AS avg_score, CASE WHEN chases > 0 THEN chases_won * 100.0::DOUBLE / chases END AS chase_pct, CASE WHEN defences > 0 THEN defences_won * 100.0::DOUBLE / defences END AS defend_pct FROM (
 SELECT team, format, count(*) AS matches, count_if(result_type = 'win' AND winner = team) AS wins, CAST(sum(scored) AS BIGINT) AS runs, CAST(sum(allowed) AS BIGINT) AS runs_against, max(scored) AS highest, min(scored) AS lowest, count_if(chased) AS chases,
 count_if(chased AND result_type = 'win' AND winner = team) AS chases_won, count_if(NOT chased) AS defences, count_if(NOT chased AND result_type = 'win' AND winner = team) AS defences_won FROM sides GROUP BY ALL)) """
TB = """ tb AS (SELECT *, CASE WHEN balls > 0 THEN conceded * 6.0::DOUBLE / balls END AS economy FROM (SELECT bowling_team AS team, format, count_if(legal) AS balls, CAST(sum(charged) AS BIGINT) AS conceded, count_if(credited) AS wickets, count_if(legal AND runs_total = 0) AS dots FROM flags GROUP BY ALL)) """
query("team_bowling", "," + TB + "SELECT * FROM tb")(lambda t: o.team_bowling(t.deliveries))
STRENGTH = """ z AS (SELECT team, format, coalesce((avg_score - min(avg_score) OVER f) / nullif(max(avg_score) OVER f - min(avg_score) OVER f, 0) * 100, 50.0) AS batting_score,
 coalesce((max(economy) OVER f - economy) / nullif(max(economy) OVER f - min(economy) OVER f, 0) * 100, 50.0) AS bowling_score, wins * 100.0::DOUBLE / matches AS wr FROM tp LEFT JOIN tb USING (team, format) WINDOW f AS (PARTITION BY format)),
st AS (SELECT team, format, batting_score, bowling_score, 0.35::DOUBLE * batting_score + 0.35::DOUBLE * bowling_score + 0.30::DOUBLE * wr AS strength FROM z) """
query("team_strength", PERF + "," + TB + "," + STRENGTH + "SELECT * FROM st")(lambda t: o.team_strength(o.team_performance(sides(t)), o.team_bowling(t.deliveries)))
for _name, _team, _runs, _wk in (("team_phase_batting", "batting_team", "runs_total", "is_wicket"), ("team_phase_bowling", "bowling_team", "charged", "credited")):
    query(_name, f"""SELECT *, runs / matches::DOUBLE AS runs_per_match, CASE WHEN balls > 0 THEN runs * 6.0::DOUBLE / balls END AS economy FROM (
SELECT {_team} AS team, format, phase, count(DISTINCT match_id) AS matches, CAST(sum({_runs}) AS BIGINT) AS runs, count_if(legal) AS balls, count_if({_wk}) AS wickets FROM flags GROUP BY ALL)""")(lambda t, b=_team == "bowling_team": o.team_phases(t.deliveries, bowling=b))
H2H = """SELECT least(team_a, team_b) AS team_1, greatest(team_a, team_b) AS team_2, format, count(*) AS matches, count_if(result_type = 'win' AND winner = least(team_a, team_b)) AS wins_1,
count_if(result_type = 'win' AND winner = greatest(team_a, team_b)) AS wins_2, count_if(result_type = 'draw') AS draws, count_if(result_type = 'tie') AS ties FROM matches GROUP BY ALL"""
query("head_to_head", H2H)(lambda t: o.head_to_head(t.matches))
query("join_symmetric_pair", f"SELECT * FROM ({H2H}) WHERE team_1 = 'Team0' AND team_2 = 'Team2'")(lambda t: o.head_to_head(t.matches.where("team_a in ('Team0', 'Team2') and team_b in ('Team0', 'Team2')")))

VB = """ vb AS (SELECT *, CASE WHEN balls > 0 THEN runs * 6.0::DOUBLE / balls END AS run_rate, (fours + sixes) / matches::DOUBLE AS boundaries_per_match FROM (SELECT venue, format, count(DISTINCT match_id) AS matches, CAST(sum(runs_total) AS BIGINT) AS runs,
 count_if(legal) AS balls, count_if(credited) AS wickets, count_if(four) AS fours, count_if(six) AS sixes, CAST(sum(CASE WHEN phase = 'powerplay' THEN runs_total ELSE 0 END) AS BIGINT) AS powerplay_runs,
 CAST(sum(CASE WHEN phase = 'middle' THEN runs_total ELSE 0 END) AS BIGINT) AS middle_runs, CAST(sum(CASE WHEN phase = 'death' THEN runs_total ELSE 0 END) AS BIGINT) AS death_runs, CAST(sum(CASE WHEN phase = 'general' THEN runs_total ELSE 0 END) AS BIGINT) AS general_runs FROM flags GROUP BY venue, format)) """
VM = """ vm AS (SELECT *, first_runs / matches::DOUBLE AS avg_first, coalesce(chases_won * 100.0::DOUBLE / nullif(chases_won + defences_won, 0), 50.0) AS chase_pct FROM (SELECT venue, format, count(*) AS matches, CAST(sum(first_runs) AS BIGINT) AS first_runs,
 CAST(sum(second_runs) AS BIGINT) AS second_runs, max(greatest(first_runs, second_runs)) AS highest, min(least(first_runs, second_runs)) AS lowest, count_if(result_type = 'win' AND winner = team_b) AS chases_won, count_if(result_type = 'win' AND winner = team_a) AS defences_won,
 count_if(toss_decision = 'bat') AS bat_first_tosses, count_if(result_type = 'win' AND winner = toss_winner) AS toss_wins FROM matches GROUP BY venue, format)) """
for _name, _cols in (("venue_comprehensive", "*"), ("venue_phase_stats", "venue, format, matches, powerplay_runs, middle_runs, death_runs, general_runs"), ("venue_wicket_stats", "venue, format, matches, wickets"), ("venue_boundary_stats", "venue, format, fours, sixes, boundaries_per_match")):
    query(_name, f",{VB} SELECT {_cols} FROM vb")(lambda t, c=_cols: o.venue_balls(t.deliveries).select(*c.split(", ")))
for _name, _cols in (("venue_match_stats", "venue, format, matches, first_runs, second_runs, highest, lowest, avg_first"), ("venue_chase_stats", "venue, format, chases_won, defences_won, chase_pct"), ("venue_by_format", "*")):
    query(_name, f",{VM} SELECT {_cols} FROM vm")(lambda t, c=_cols: o.venue_matches(t.matches).select(*c.split(", ")))
query("venue_stats", f",{VB},{VM} SELECT * FROM vb JOIN vm USING (venue, format, matches)")(lambda t: o.venue_balls(t.deliveries).join(o.venue_matches(t.matches).drop("matches"), ["venue", "format"]))
query("join_venue_metrics", f",{VB},{VM} SELECT venue, format, run_rate, chase_pct FROM vb JOIN vm USING (venue, format)")(lambda t: o.venue_balls(t.deliveries).join(o.venue_matches(t.matches).drop("matches"), ["venue", "format"]).select("venue", "format", "run_rate", "chase_pct"))
query("venue_toss_stats", "SELECT venue, toss_decision, count(*) AS matches, count_if(result_type = 'win' AND winner = toss_winner) AS won FROM matches GROUP BY ALL")(lambda t: o.venue_toss(t.matches))
query("venue_innings_stats", """SELECT venue, format, innings_number, count(*) AS innings, CAST(sum(runs) AS BIGINT) AS runs, CAST(floor(stddev_samp(runs) * 1e6 + 0.5) AS BIGINT) AS deviation FROM (
SELECT venue, format, match_id, innings_number, sum(runs_total)::DOUBLE AS runs FROM flags GROUP BY ALL) GROUP BY ALL""")(
    lambda t: t.deliveries.groupBy("venue", "format", "match_id", "innings_number").agg(F.sum("runs_total").alias("runs")).groupBy("venue", "format", "innings_number").agg(
        F.count("*").alias("innings"), F.sum("runs").cast("long").alias("runs"), F.floor(F.stddev_samp("runs") * 1e6 + 0.5).cast("long").alias("deviation"))
)
query("venue_rollup", f",{VM} SELECT venue, CAST(sum(matches) AS BIGINT) AS matches, sum(avg_first * matches) / sum(matches) AS avg_first FROM (SELECT venue, format, matches, first_runs::DOUBLE / matches AS avg_first FROM vm) GROUP BY venue")(
    lambda t: o.venue_matches(t.matches).groupBy("venue").agg(F.sum("matches").alias("matches"), (F.sum(F.col("avg_first") * F.col("matches")) / F.sum("matches")).alias("avg_first"))
)
query("team_rollup", PERF + "SELECT team, CAST(sum(matches) AS BIGINT) AS matches, sum(avg_score * matches) / sum(matches) AS avg_score FROM tp WHERE format IN ('T20I', 'ODI', 'Test') GROUP BY team")(
    lambda t: o.team_performance(sides(t)).where("format in ('T20I', 'ODI', 'Test')").groupBy("team").agg(F.sum("matches").alias("matches"), (F.sum(F.col("avg_score") * F.col("matches")) / F.sum("matches")).alias("avg_score"))
)
query("score_lines", """SELECT match_id, batting_team, string_agg(runs || '/' || wickets, ' & ' ORDER BY innings_number) AS score FROM (
SELECT match_id, batting_team, innings_number, CAST(sum(runs_total) AS BIGINT) AS runs, count_if(is_wicket) AS wickets FROM flags GROUP BY ALL) GROUP BY ALL""")(lambda t: o.score_lines(t.deliveries))

MCOLS = "match_id, match_date, format, venue, team_a, team_b, competition, season, match_number, winner, result_type"
ML = MCOLS.split(", ")


def page(df, n, *order):
    return df.orderBy(*order).limit(n)


def newest():
    return F.desc("match_date"), F.desc("match_number"), F.col("match_id")


NEW = "match_date DESC, match_number DESC, match_id"
query("list_matches", f"SELECT {MCOLS} FROM matches WHERE format = 'T20I' ORDER BY {NEW} LIMIT 50 OFFSET 10")(lambda t: t.matches.where("format = 'T20I'").select(*ML).orderBy(*newest()).offset(10).limit(50))
query("get_match", f"SELECT {MCOLS} FROM matches WHERE match_id = 'm5'")(lambda t: t.matches.where("match_id = 'm5'").select(*ML))
query("dash_recent_matches", f"SELECT {MCOLS} FROM matches ORDER BY {NEW} LIMIT 8")(lambda t: page(t.matches.select(*ML), 8, *newest()))
query("season_match_list", f"SELECT {MCOLS} FROM matches WHERE competition = 'Cup 1' AND season = '2022' ORDER BY {NEW} LIMIT 100")(lambda t: page(t.matches.where("competition = 'Cup 1' and season = '2022'").select(*ML), 100, *newest()))
query("season_matches", f"SELECT {MCOLS} FROM matches WHERE competition = 'Cup 2' AND season = '2022' ORDER BY match_date, match_id LIMIT 20 OFFSET 5")(lambda t: t.matches.where("competition = 'Cup 2' and season = '2022'").select(*ML).orderBy("match_date", "match_id").offset(5).limit(20))
query("team_history", SIDES + "SELECT * FROM (SELECT team, match_id, match_date, opponent, CAST(row_number() OVER (PARTITION BY team ORDER BY match_date DESC, match_id) AS INT) AS n FROM sides) WHERE n <= 10")(
    lambda t: sides(t).select("team", "match_id", "match_date", "opponent", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("match_date"), "match_id")).alias("n")).where("n <= 10")
)
query("filter_format_scope", "SELECT match_id, format FROM matches WHERE format IN ('T20I', 'ODI', 'Test')")(lambda t: t.matches.where(F.col("format").isin("T20I", "ODI", "Test")).select("match_id", "format"))
query("filter_recent", "SELECT match_id, match_date FROM matches WHERE match_date >= DATE '2025-01-01' - 548")(lambda t: t.matches.where(F.col("match_date") >= F.date_sub(F.to_date(F.lit("2025-01-01")), 548)).select("match_id", "match_date"))
query("filter_completed", "SELECT match_id FROM matches WHERE match_date <= DATE '2024-06-30' AND result_type IN ('win', 'tie', 'draw', 'no_result', 'abandoned')")(
    lambda t: t.matches.where((F.col("match_date") <= F.to_date(F.lit("2024-06-30"))) & F.col("result_type").isin("win", "tie", "draw", "no_result", "abandoned")).select("match_id")
)
query("filter_official_ids", "SELECT match_id FROM matches WHERE regexp_matches(substr(match_id, 2), '^[0-9]+$')")(lambda t: t.matches.where(F.expr("substring(match_id, 2) rlike '^[0-9]+$'")).select("match_id"))
query("competition_list", "SELECT competition, format, count(*) AS matches FROM matches GROUP BY ALL ORDER BY competition, format LIMIT 10")(lambda t: t.matches.groupBy("competition", "format").agg(F.count("*").alias("matches")).orderBy("competition", "format").limit(10))
query("competition_summary", "SELECT competition, season, count(*) AS matches, min(match_date) AS first_date, max(match_date) AS last_date FROM matches GROUP BY ALL")(lambda t: t.matches.groupBy("competition", "season").agg(F.count("*").alias("matches"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date")))
query("competition_discovery", "SELECT competition, format FROM (SELECT *, row_number() OVER (PARTITION BY competition ORDER BY n DESC, format) AS place FROM (SELECT competition, format, count(*) AS n FROM matches GROUP BY ALL)) WHERE place = 1")(
    lambda t: t.matches.groupBy("competition", "format").agg(F.count("*").alias("n")).groupBy("competition").agg(F.min_by("format", F.struct(-F.col("n"), F.col("format"))).alias("format"))
)
query("season_list", "SELECT DISTINCT season FROM matches WHERE competition = 'Cup 1'")(lambda t: t.matches.where("competition = 'Cup 1'").select("season").distinct())
query("season_select", "SELECT competition, max(season) AS season FROM matches GROUP BY competition")(lambda t: t.matches.groupBy("competition", "season").agg(F.count("*").alias("n"), F.max("match_date").alias("last")).groupBy("competition").agg(F.max_by("season", F.struct(F.col("n") > 0, F.col("last"))).alias("season")))
query("season_champion", "SELECT competition, season, arg_max(coalesce(winner, '-'), (match_date, match_number)) AS champion FROM matches GROUP BY ALL")(
    lambda t: t.matches.groupBy("competition", "season").agg(F.max_by(F.coalesce("winner", F.lit("-")), F.struct("match_date", "match_number")).alias("champion"))
)
query("season_team_table", SIDES + "SELECT competition, season, team, count(*) AS matches, count_if(result_type = 'win' AND winner = team) AS wins FROM sides GROUP BY ALL")(lambda t: o.team_records(sides(t), "competition", "season").select("competition", "season", "team", "matches", "wins"))
query("season_venue_list", "SELECT competition, season, venue, count(*) AS matches, sum(first_runs)::DOUBLE / count(*) AS avg_first FROM matches GROUP BY ALL")(
    lambda t: t.matches.groupBy("competition", "season", "venue").agg(F.count("*").alias("matches"), (F.sum("first_runs").cast("double") / F.count("*")).alias("avg_first"))
)
query("dash_top_venues", "SELECT venue, count(*) AS matches FROM matches GROUP BY venue ORDER BY matches DESC, venue LIMIT 6")(lambda t: t.matches.groupBy("venue").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "venue").limit(6))
query("list_venues", "SELECT venue, count(*) AS matches, max(match_date) AS last_date FROM matches GROUP BY venue ORDER BY last_date DESC, matches DESC, venue LIMIT 20")(lambda t: t.matches.groupBy("venue").agg(F.count("*").alias("matches"), F.max("match_date").alias("last_date")).orderBy(F.desc("last_date"), F.desc("matches"), "venue").limit(20))
query("list_teams", records() + " ORDER BY win_rate DESC, team LIMIT 20")(lambda t: o.team_records(sides(t)).orderBy(F.desc("win_rate"), "team").limit(20))
query("semi_venue_members", "SELECT DISTINCT venue FROM matches v WHERE EXISTS (SELECT 1 FROM matches x WHERE x.venue = v.venue AND x.team_a = 'Team0' AND x.team_b = 'Team1')")(
    lambda t: t.matches.select("venue").distinct().join(t.matches.where("team_a = 'Team0' and team_b = 'Team1'").select("venue"), "venue", "left_semi")
)

"""Registered queries over merged partial results and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.operators import careers as c
from wicketflow.operators import innings as i
from wicketflow.operators import merges as g
from wicketflow.operators import teams as o
from wicketflow.plans.innings_queries import BAT_SQL, BOWL_SQL
from wicketflow.plans.player_queries import bat, bowl, career_bat_sql, career_bowl_sql
from wicketflow.plans.team_queries import PERF, VM, sides
from wicketflow.registry import query


def chunked(df):
    return df.withColumn("chunk", F.substring("match_id", 2, 9).cast("int") % 4)


query("chunk_merge_bowling", f", {BOWL_SQL}, cw AS ({career_bowl_sql('bowler, format')}) SELECT bowler, format, matches, innings, balls, conceded, wickets, dots, best_wickets, best_runs, economy FROM cw")(
    lambda t: g.merge_bowling(c.career_bowling(chunked(bowl(t)), ("bowler", "format", "chunk")))
)
MATCHUP = "SELECT batter, bowler, format, count(DISTINCT match_id) AS matches, count_if(faced) AS balls, CAST(sum(runs_batter) AS BIGINT) AS runs, count_if(credited AND dismissed_player = batter) AS dismissals, count_if(faced AND runs_total = 0) AS dots, count_if(four OR six) AS boundaries FROM flags GROUP BY batter, bowler, format"


def parts(t):
    """Matchups of each chunk, in one grouping."""
    return c.matchups(chunked(t.deliveries), least=0, keys=("batter", "bowler", "format", "chunk"))


query("chunk_merge_matchups", f"SELECT *, runs * 100.0::DOUBLE / balls AS strike_rate FROM ({MATCHUP}) WHERE balls >= 10")(lambda t: g.merge_matchups(parts(t)))
query("chunk_merge_teams", PERF + "SELECT team, format, matches, wins, highest, CAST(floor(avg_score * 1e6 + 0.5) AS BIGINT) AS avg_score FROM tp")(
    lambda t: g.merge_teams(o.team_performance(chunked(sides(t)).where("chunk < 2")).unionByName(o.team_performance(chunked(sides(t)).where("chunk >= 2")))).withColumn("avg_score", F.floor(F.col("avg_score") * 1e6 + 0.5).cast("long"))
)
query("chunk_merge_venues", f",{VM} SELECT venue, format, matches, CASE WHEN highest <= 500 THEN highest END AS highest, lowest, CAST(floor(avg_first * 1e6 + 0.5) AS BIGINT) AS avg_first FROM vm")(
    lambda t: g.merge_venues(o.venue_matches(chunked(t.matches).where("chunk < 2")).unionByName(o.venue_matches(chunked(t.matches).where("chunk >= 2")))).withColumn("avg_first", F.floor(F.col("avg_first") * 1e6 + 0.5).cast("long"))
)
query("chunk_merge_form", f", {BAT_SQL} SELECT player, format, arg_max(runs, CAST(substr(match_id, 2) AS INT) * 10 + innings_number) AS runs FROM bl GROUP BY player, format")(
    lambda t: g.merge_latest(bat(t).select("player", "format", "runs", (F.substring("match_id", 2, 9).cast("int") * 10 + F.col("innings_number")).alias("chunk")), ["player", "format"], "chunk")
)
query("season_overrides", f", {BAT_SQL}, cb AS ({career_bat_sql('player, format')}) SELECT player, format, matches + CASE WHEN player LIKE '%P1' THEN 1 ELSE 0 END AS matches, CASE WHEN player LIKE '%P1' THEN 999 ELSE runs END AS runs FROM cb")(
    lambda t: g.overlay(
        c.career_batting(bat(t)).select("player", "format", "matches", "runs"),
        c.career_batting(bat(t)).where("player like '%P1'").select("player", "format", (F.col("matches") + 1).alias("matches"), F.lit(999).cast("long").alias("runs")),
        ["player", "format"],
    )
)
query("scan_reference_rows", "SELECT match_id, team_a AS first, team_b AS second, CAST(NULL AS VARCHAR) AS third FROM matches")(lambda t: g.reference_rows(t.matches.select("match_id", F.array("team_a", "team_b").alias("cells")), ["first", "second", "third"]))
query("shared_rank_fill", "SELECT match_id, format AS list, CAST(last_value(CASE WHEN match_number % 3 = 0 THEN match_number END IGNORE NULLS) OVER (PARTITION BY format ORDER BY match_date ROWS UNBOUNDED PRECEDING) AS INT) AS rank FROM matches")(
    lambda t: g.shared_rank(t.matches.select("match_id", F.col("format").alias("list"), "match_date", F.when(F.col("match_number") % 3 == 0, F.col("match_number").cast("string")).otherwise("=").alias("rank")), "match_date").drop("match_date")
)
query("weighted_mean", f", {BAT_SQL} SELECT format, sum(CASE WHEN balls > 0 THEN runs * balls END)::DOUBLE / sum(CASE WHEN balls > 0 THEN balls END) AS mean FROM bl GROUP BY format")(
    lambda t: bat(t).groupBy("format").agg(c.weighted_mean("runs", "balls").cast("double").alias("mean"))
)
query("join_player_summary", f", {BAT_SQL}, cb AS ({career_bat_sql('player, format')}) SELECT player, bowling_style, format, runs FROM players LEFT JOIN cb USING (player)")(lambda t: t.players.join(c.career_batting(bat(t)).select("player", "format", "runs"), "player", "left").select("player", "bowling_style", "format", "runs"))

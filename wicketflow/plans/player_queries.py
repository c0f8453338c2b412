"""Registered queries over players, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.operators import careers as c
from wicketflow.operators import innings as i
from wicketflow.plans.innings_queries import BAT_SQL, BOWL_SQL
from wicketflow.registry import query


def bat(t):
    return i.batting_lines(t.deliveries)


def bowl(t):
    return i.bowling_lines(t.deliveries)


def career_bat_sql(keys: str, source: str = "bl") -> str:
    return f"""SELECT *, CASE WHEN innings > not_outs THEN runs / (innings - not_outs)::DOUBLE END AS average, CASE WHEN balls > 0 THEN runs * 100.0::DOUBLE / balls END AS strike_rate FROM (
SELECT {keys}, count(DISTINCT match_id) AS matches, count(*) AS innings, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(balls) AS BIGINT) AS balls, CAST(sum(fours) AS BIGINT) AS fours, CAST(sum(sixes) AS BIGINT) AS sixes,
count_if(NOT out) AS not_outs, max(runs) AS highest, count_if(runs >= 50 AND runs < 100) AS fifties, count_if(runs >= 100) AS hundreds FROM {source} GROUP BY {keys})"""


def career_bowl_sql(keys: str, source: str = "wl") -> str:
    return f"""SELECT *, CASE WHEN balls > 0 THEN conceded * 6.0::DOUBLE / balls END AS economy, CASE WHEN wickets > 0 THEN conceded / wickets::DOUBLE END AS average, CASE WHEN wickets > 0 THEN balls / wickets::DOUBLE END AS strike_rate FROM (
SELECT {keys}, count(DISTINCT match_id) AS matches, count(*) AS innings, CAST(sum(balls) AS BIGINT) AS balls, CAST(sum(conceded) AS BIGINT) AS conceded, CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(dots) AS BIGINT) AS dots,
count_if(wickets = 4) AS fours_w, count_if(wickets >= 5) AS fives_w, max(wickets) AS best_wickets, CAST(min(conceded - 100000 * wickets) + 100000 * max(wickets) AS BIGINT) AS best_runs FROM {source} GROUP BY {keys})"""


def opponent(lines):
    return lines.withColumnRenamed("bowling_team", "opponent")


BL, WL = f", {BAT_SQL} ", f", {BOWL_SQL} "
BLM = f", {BAT_SQL}, bm AS (SELECT bl.*, year(bl.match_date) AS year, competition, season, bowling_team AS opponent FROM bl JOIN matches USING (match_id)) "
WLM = f", {BOWL_SQL}, wm AS (SELECT wl.*, year(wl.match_date) AS year, competition, season, batting_team AS opponent FROM wl JOIN matches USING (match_id)) "


def with_match(t, lines):
    return lines.withColumn("year", F.year("match_date").cast("long")).join(t.matches.select("match_id", "competition", "season"), "match_id")


query("career_batting", BL + career_bat_sql("player, format"))(lambda t: c.career_batting(bat(t)))
query("career_bowling", WL + career_bowl_sql("bowler, format"))(lambda t: c.career_bowling(bowl(t)))
query("player_career", BL + career_bat_sql("player, format") + " WHERE player = 'T0P3'")(lambda t: c.career_batting(bat(t).where("player = 'T0P3'")))
for _key, _name in (("year", "player_by_year"), ("competition", "player_by_competition"), ("season", "player_by_season"), ("opponent", "player_vs_opponent"), ("venue", "player_at_venue")):
    query(_name, BLM + career_bat_sql(f"player, format, {_key}", "bm"))(lambda t, k=_key: c.career_batting(with_match(t, bat(t)).withColumn("opponent", F.col("bowling_team")), ("player", "format", k)))
    query(f"{_name}_bowling", WLM + career_bowl_sql(f"bowler, format, {_key}", "wm"))(lambda t, k=_key: c.career_bowling(with_match(t, bowl(t)).withColumn("opponent", F.col("batting_team")), ("bowler", "format", k)))
query("join_opponent_role", BLM + "SELECT player, opponent, CAST(sum(runs) AS BIGINT) AS runs FROM bm GROUP BY ALL")(lambda t: bat(t).groupBy("player", F.col("bowling_team").alias("opponent")).agg(F.sum("runs").alias("runs")))
query("batting_by_phase", """SELECT *, CASE WHEN balls > 0 THEN runs * 100.0::DOUBLE / balls END AS rate FROM (SELECT batter AS player, format, phase, CAST(sum(runs_batter) AS BIGINT) AS runs, count_if(faced) AS balls,
count_if(faced AND runs_total = 0) AS dots, count_if(credited) AS wickets, count_if(four OR six) AS boundaries FROM flags GROUP BY ALL)""")(lambda t: c.by_phase(t.deliveries))
query("bowling_by_phase", """SELECT *, CASE WHEN balls > 0 THEN runs * 6.0::DOUBLE / balls END AS rate FROM (SELECT bowler AS player, format, phase, CAST(sum(charged) AS BIGINT) AS runs, count_if(legal) AS balls,
count_if(legal AND runs_total = 0) AS dots, count_if(credited) AS wickets, count_if(four OR six) AS boundaries FROM flags GROUP BY ALL)""")(lambda t: c.by_phase(t.deliveries, bowling=True))
query("batting_by_situation", BL + """SELECT *, CASE WHEN outs > 0 THEN runs / outs::DOUBLE END AS average FROM (SELECT player, format, CASE WHEN innings_number = 2 THEN 'chasing' ELSE 'setting' END AS situation,
count(*) AS innings, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(balls) AS BIGINT) AS balls, count_if(out) AS outs FROM bl GROUP BY ALL)""")(lambda t: c.by_situation(bat(t)))


def rounded(df, *names):
    """Deviations differ in the last bits between engines."""
    return df.select(*[F.floor(F.col(x) * 1e6 + 0.5).cast("long").alias(x) if x in names else F.col(x) for x in df.columns])


query("consistency", BL + """SELECT player, format, innings, mean, CAST(floor(deviation * 1e6 + 0.5) AS BIGINT) AS deviation, CAST(floor(consistency * 1e6 + 0.5) AS BIGINT) AS consistency FROM (
SELECT *, CASE WHEN mean > 0 THEN greatest(0.0::DOUBLE, (1 - deviation / mean) * 100) END AS consistency FROM (
SELECT player, format, count(*) AS innings, sum(runs)::DOUBLE / count(*) AS mean, stddev_samp(runs) AS deviation FROM bl GROUP BY player, format HAVING count(*) >= 5))""")(lambda t: rounded(c.consistency(bat(t)), "deviation", "consistency"))
query("recent_batting", BL + """SELECT player, format, count(*) AS innings, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(balls) AS BIGINT) AS balls, quantile_disc(runs, 0.5) AS median_runs, max(match_date) AS last_match
FROM bl WHERE match_date >= (SELECT max(match_date) - 548 FROM bl) GROUP BY player, format""")(lambda t: c.recent_batting(bat(t)))
query("player_recent_stats", f""", {BAT_SQL}, {BOWL_SQL}, u AS (SELECT player, format, match_id, match_date, 1 AS bat, runs, balls AS faced, 0 AS bowl, 0 AS wickets, 0 AS bowled, 0 AS conceded FROM bl
 UNION ALL SELECT bowler, format, match_id, match_date, 0, 0, 0, 1, wickets, balls, conceded FROM wl)
SELECT player, format, count(DISTINCT match_id) AS matches, CAST(sum(bat) AS BIGINT) AS batting_innings, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(faced) AS BIGINT) AS balls_faced, CAST(sum(bowl) AS BIGINT) AS bowling_innings,
CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(bowled) AS BIGINT) AS balls_bowled, CAST(sum(conceded) AS BIGINT) AS runs_conceded, max(match_date) AS last_match_date FROM u
WHERE match_date >= (SELECT max(match_date) - 548 FROM u) GROUP BY player, format""")(lambda t: c.recent_stats(bat(t), bowl(t)))
query("career_progression", BL + """SELECT *, CAST(sum(innings) OVER w AS BIGINT) AS total_innings, CAST(sum(runs) OVER w AS BIGINT) AS total_runs FROM (
SELECT player, format, CAST(year(match_date) AS INT) AS year, count(*) AS innings, CAST(sum(runs) AS BIGINT) AS runs FROM bl GROUP BY ALL) WINDOW w AS (PARTITION BY player, format ORDER BY year ROWS UNBOUNDED PRECEDING)""")(lambda t: c.progression(bat(t)))

MU_SQL = """mu AS (SELECT *, CASE WHEN balls > 0 THEN runs * 100.0::DOUBLE / balls END AS strike_rate, CASE WHEN dismissals > 0 THEN runs / dismissals::DOUBLE END AS average, CASE WHEN balls > 0 THEN dots * 100.0::DOUBLE / balls END AS dot_pct,
 CASE WHEN balls > 0 THEN boundaries * 100.0::DOUBLE / balls END AS boundary_pct FROM (SELECT batter, bowler, format, count(DISTINCT match_id) AS matches, count_if(faced) AS balls, CAST(sum(runs_batter) AS BIGINT) AS runs,
 count_if(credited AND dismissed_player = batter) AS dismissals, count_if(faced AND runs_total = 0) AS dots, count_if(four OR six) AS boundaries FROM flags GROUP BY batter, bowler, format) WHERE balls >= 10)"""
MU = f", {MU_SQL} "
query("matchups", MU + "SELECT * FROM mu")(lambda t: c.matchups(t.deliveries))
query("direct_matchups", MU + "SELECT * FROM mu")(lambda t: c.matchups(t.deliveries))
query("matchups_basic", MU + "SELECT batter, bowler, format, balls, runs, dismissals, strike_rate, average FROM mu")(lambda t: c.matchups(t.deliveries).select("batter", "bowler", "format", "balls", "runs", "dismissals", "strike_rate", "average"))
query("top_matchups", MU + "SELECT * FROM mu ORDER BY runs DESC, batter, bowler, format LIMIT 50")(lambda t: c.matchups(t.deliveries).orderBy(F.desc("runs"), "batter", "bowler", "format").limit(50))
query("matchup_pair", MU + "SELECT format, matches, balls, runs, dismissals FROM mu WHERE batter = 'T0P0' AND bowler = 'T1P5'")(
    lambda t: c.matchups(t.deliveries.where("batter = 'T0P0' AND bowler = 'T1P5'")).select("format", "matches", "balls", "runs", "dismissals")
)
query("player_matchups", MU + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY batter ORDER BY runs DESC, bowler, format) AS INT) AS n FROM mu) WHERE n <= 20")(
    lambda t: c.matchups(t.deliveries).withColumn("n", F.row_number().over(c.Window.partitionBy("batter").orderBy(F.desc("runs"), "bowler", "format"))).where("n <= 20")
)
STYLE = """, sm AS (SELECT batter, f.format, CASE WHEN bowling_style LIKE 'left%' THEN 'left' WHEN bowling_style LIKE 'right%' THEN 'right' END AS arm,
 CASE WHEN bowling_style LIKE '%fast%' THEN 'pace' WHEN bowling_style IS NOT NULL THEN 'spin' END AS pace_spin, faced, runs_batter, credited FROM flags f LEFT JOIN players p ON p.player = f.bowler)
SELECT *, CASE WHEN balls > 0 THEN runs * 100.0::DOUBLE / balls END AS strike_rate FROM (SELECT batter, format, {by}, count_if(faced) AS balls, CAST(sum(runs_batter) AS BIGINT) AS runs, count_if(credited) AS wickets FROM sm GROUP BY ALL)"""
query("pace_spin_matchups", STYLE.format(by="pace_spin"))(lambda t: c.style_matchups(t.deliveries, t.players, "pace_spin"))
query("arm_matchups", STYLE.format(by="arm"))(lambda t: c.style_matchups(t.deliveries, t.players, "arm"))
query("bowling_style_class", "SELECT player, CASE WHEN bowling_style LIKE 'left%' THEN 'left' ELSE 'right' END AS arm, CASE WHEN bowling_style LIKE '%fast%' THEN 'pace' ELSE 'spin' END AS pace_spin FROM players")(lambda t: t.players.select("player", *c.style_class()))
query("season_player_stats", BLM + f", {BOWL_SQL}, x AS (" + career_bat_sql("player, season", "bm") + "), y AS (" + career_bowl_sql("bowler, season", "(SELECT wl.*, season FROM wl JOIN matches USING (match_id))") + """)
SELECT coalesce(x.player, y.bowler) AS player, coalesce(x.season, y.season) AS season, x.runs, x.average AS bat_average, y.wickets, y.economy, y.best_wickets, y.best_runs
FROM x FULL JOIN y ON x.player = y.bowler AND x.season = y.season""")(
    lambda t: c.career_batting(with_match(t, bat(t)), ("player", "season")).select("player", "season", "runs", F.col("average").alias("bat_average")).join(
        c.career_bowling(with_match(t, bowl(t)), ("bowler", "season")).select(F.col("bowler").alias("player"), "season", "wickets", "economy", "best_wickets", "best_runs"), ["player", "season"], "full")
)
CHUNK = BL + ", q AS (" + career_bat_sql("player, format, chunk", "(SELECT *, CAST(substr(match_id, 2) AS INT) % 4 AS chunk FROM bl)") + ") "
query("chunk_merge_batting", CHUNK + """SELECT *, CASE WHEN innings > not_outs THEN runs / (innings - not_outs)::DOUBLE END AS average, CASE WHEN balls > 0 THEN runs * 100.0::DOUBLE / balls END AS strike_rate FROM (
SELECT player, format, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(innings) AS BIGINT) AS innings, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(balls) AS BIGINT) AS balls, CAST(sum(fours) AS BIGINT) AS fours, CAST(sum(sixes) AS BIGINT) AS sixes,
CAST(sum(not_outs) AS BIGINT) AS not_outs, CAST(sum(fifties) AS BIGINT) AS fifties, CAST(sum(hundreds) AS BIGINT) AS hundreds, max(highest) AS highest FROM q WHERE not_outs <= innings AND highest <= 264 GROUP BY player, format)""")(
    lambda t: c.merge_batting(c.career_batting(bat(t).withColumn("chunk", F.substring("match_id", 2, 9).cast("int") % 4), ("player", "format", "chunk")))
)

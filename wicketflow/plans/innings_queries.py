"""Registered queries over single innings, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.operators import innings as i
from wicketflow.registry import query

KEY = ["match_id", "innings_number", "over_number", "ball_in_over"]
K = ", ".join(KEY)

for _name, _column, _sql in (
    ("pred_ball_faced", lambda: r.ball_faced(), "faced"),
    ("pred_legal_ball", lambda: r.legal_ball(), "legal"),
    ("proj_bowler_runs", lambda: r.bowler_runs().cast("long"), "CAST(charged AS BIGINT)"),
    ("pred_bowler_wicket", lambda: r.bowler_wicket(), "coalesce(credited, false)"),
    ("pred_batter_out", lambda: r.batter_out(), "coalesce(dismissed, false)"),
    ("pred_boundary", lambda: r.boundary(4) | r.boundary(6), "(four OR six)"),
    ("proj_phase", lambda: r.phase(), "phase"),
    ("proj_is_chasing", lambda: F.col("innings_number") == 2, "innings_number = 2"),
    ("fn_innings_id", lambda: F.concat_ws("-", "match_id", "innings_number"), "match_id || '-' || innings_number"),
    ("fn_current_over", lambda: F.col("over_number") + F.col("ball_in_over") / F.lit(6.0), "over_number + ball_in_over / 6.0::DOUBLE"),
    ("fn_format_flags", lambda: F.col("format").isin(*r.MULTI_DAY), "format = 'Test'"),
    ("proj_bowling_team", lambda: F.array_except(F.array("team_a", "team_b"), F.array("batting_team"))[0], "CASE WHEN batting_team = team_a THEN team_b ELSE team_a END"),
):
    query(_name, f"SELECT {K}, {_sql} AS value FROM flags")(lambda t, c=_column: t.deliveries.select(*KEY, c().alias("value")))

COLUMNS = "match_id, match_date, format, venue, innings_number, over_number, ball_in_over, batting_team, bowling_team, batter, bowler, runs_total"
COLUMN_LIST = COLUMNS.split(", ")

query("validate_deliveries", f"SELECT {COLUMNS} FROM deliveries WHERE batter IS NOT NULL AND bowler IS NOT NULL AND runs_total >= 0 AND over_number >= 0 AND (over_number <= 100 OR format = 'Test')")(
    lambda t: i.dedupe_events(i.validate(t.deliveries)).select(*COLUMN_LIST)
)
query("validate_deliveries_strict", f"SELECT {COLUMNS} FROM deliveries WHERE batter IS NOT NULL AND bowler IS NOT NULL AND runs_total >= 0 AND over_number BETWEEN 0 AND 100 AND ball_in_over BETWEEN 1 AND 9")(
    lambda t: i.validate(t.deliveries, strict=True).select(*COLUMN_LIST)
)
query("dedupe_events", f"SELECT {COLUMNS} FROM deliveries")(
    # every 97th ball comes twice
    lambda t: i.dedupe_events(t.deliveries.unionByName(t.deliveries.where((F.col("over_number") * 7 + F.col("ball_in_over")) % 97 == 0))).select(*COLUMN_LIST)
)
query("cumulative_innings", f"""SELECT {K}, CAST(sum(runs_total) OVER w AS BIGINT) AS cum_runs, CAST(sum(CAST(is_wicket AS INT)) OVER w AS BIGINT) AS cum_wickets
FROM deliveries WINDOW w AS (PARTITION BY match_id, innings_number ORDER BY over_number, ball_in_over ROWS UNBOUNDED PRECEDING)""")(
    lambda t: i.cumulative(t.deliveries).select(*KEY, "cum_runs", "cum_wickets")
)
query("join_match_context", f"SELECT {K}, first_runs AS first_innings_total, CASE WHEN innings_number = 2 THEN first_runs + 1 END AS target FROM deliveries JOIN matches USING (match_id)")(
    lambda t: i.match_context(t.deliveries).select(*KEY, "first_innings_total", "target")
)
query("phase_stats", """SELECT match_id, innings_number, phase, CAST(sum(runs_total) AS BIGINT) AS runs, count_if(legal) AS balls, count_if(is_wicket) AS wickets,
count_if(four OR six) AS boundaries, count_if(legal AND runs_total = 0) AS dots FROM flags GROUP BY ALL""")(lambda t: i.phase_stats(t.deliveries))

BAT_SQL = """bl AS (SELECT format, match_id, match_date, venue, innings_number, batting_team, bowling_team, player, CAST(sum(rb) AS BIGINT) AS runs, count_if(faced) AS balls, count_if(four) AS fours, count_if(six) AS sixes,
 count_if(faced AND rt = 0) AS dots, bool_or(gone) AS out FROM (
 SELECT format, match_id, match_date, venue, innings_number, batting_team, bowling_team, batter AS player, runs_batter AS rb, runs_total AS rt, faced, four, six, false AS gone FROM flags
 UNION ALL SELECT format, match_id, match_date, venue, innings_number, batting_team, bowling_team, dismissed_player, 0, 0, false, false, false, true FROM flags WHERE dismissed) GROUP BY ALL)"""
BOWL_SQL = """wl AS (SELECT format, match_id, match_date, venue, innings_number, bowling_team, batting_team, bowler, count_if(legal) AS balls, CAST(sum(charged) AS BIGINT) AS conceded, count_if(credited) AS wickets,
 count_if(legal AND runs_total = 0) AS dots, count_if(four OR six) AS boundaries, CAST(sum(extras_wides) AS BIGINT) AS wides, CAST(sum(extras_noballs) AS BIGINT) AS noballs FROM flags GROUP BY ALL)"""

query("player_innings", f", {BAT_SQL} SELECT * FROM bl")(lambda t: i.batting_lines(t.deliveries))
query("join_dismissals", f", {BAT_SQL} SELECT match_id, innings_number, player, out FROM bl")(lambda t: i.batting_lines(t.deliveries).select("match_id", "innings_number", "player", "out"))
query("bowler_innings", f", {BOWL_SQL} SELECT * FROM wl")(lambda t: i.bowling_lines(t.deliveries))
query("innings_totals", """SELECT *, (floor(balls / 6.0) * 10 + balls % 6) / 10.0::DOUBLE AS overs FROM (SELECT format, match_id, innings_number, batting_team, CAST(sum(runs_total) AS BIGINT) AS runs,
count_if(is_wicket) AS wickets, count_if(legal) AS balls, CAST(sum(runs_extras) AS BIGINT) AS extras FROM flags GROUP BY ALL)""")(lambda t: i.innings_totals(t.deliveries))
query("maidens", """SELECT match_id, innings_number, bowler, count_if(balls >= 6 AND charged = 0) AS maidens FROM (
SELECT match_id, innings_number, bowler, over_number, count_if(legal) AS balls, sum(charged) AS charged FROM flags GROUP BY ALL) GROUP BY ALL""")(lambda t: i.maidens(t.deliveries))

CARD_SQL = """c AS (SELECT match_id, innings_number, batting_team, over_number * 1000 + ball_in_over AS pos, runs_batter, wicket_type, CASE WHEN credited THEN bowler END AS bowler, fielder, faced, four, six, batter AS player, 0 AS role,
  dismissed AND dismissed_player = batter AS gone FROM flags
 UNION ALL SELECT match_id, innings_number, batting_team, over_number * 1000 + ball_in_over, 0, wicket_type, CASE WHEN credited THEN bowler END, fielder, false, false, false, non_striker, 1, dismissed AND dismissed_player = non_striker FROM flags),
card AS (SELECT match_id, innings_number, batting_team, player, CAST(sum(runs_batter) AS BIGINT) AS runs, count_if(faced) AS balls, count_if(four) AS fours, count_if(six) AS sixes, min(pos * 2 + role) AS first,
  coalesce(count_if(gone), 0) = 0 AS not_out, arg_min(wicket_type, pos) FILTER (gone) AS kind, min(pos) FILTER (gone) AS gone_at FROM c GROUP BY match_id, innings_number, batting_team, player),
full_card AS (SELECT card.*, g.bowler AS out_to, g.fielder, CAST(row_number() OVER (PARTITION BY card.match_id, card.innings_number ORDER BY first, card.player) AS INT) AS position
  FROM card LEFT JOIN c g ON g.match_id = card.match_id AND g.innings_number = card.innings_number AND g.player = card.player AND g.gone AND g.pos = card.gone_at)"""
CARD = "match_id, innings_number, batting_team, player, runs, balls, fours, sixes, position, not_out, kind, out_to, fielder"
query("scorecard_batting", f", {CARD_SQL} SELECT {CARD} FROM full_card")(lambda t: i.scorecard_batting(t.deliveries))
query("batting_position", f", {CARD_SQL} SELECT match_id, innings_number, player, position FROM full_card")(lambda t: i.scorecard_batting(t.deliveries).select("match_id", "innings_number", "player", "position"))
query("proj_dismissal_text", f""", {CARD_SQL} SELECT match_id, innings_number, player, CASE WHEN not_out THEN 'not out' WHEN kind = 'caught' THEN 'c ' || coalesce(fielder, '') || ' b ' || coalesce(out_to, '')
WHEN kind = 'stumped' THEN 'st ' || coalesce(fielder, '') || ' b ' || coalesce(out_to, '') WHEN kind = 'lbw' THEN 'lbw b ' || coalesce(out_to, '') WHEN kind = 'bowled' THEN 'b ' || coalesce(out_to, '')
WHEN kind = 'run out' THEN 'run out (' || coalesce(fielder, '') || ')' ELSE kind END AS dismissal FROM full_card""")(
    lambda t: i.dismissal_text(i.scorecard_batting(t.deliveries)).select("match_id", "innings_number", "player", "dismissal")
)
query("scorecard_bowling", """, ov AS (SELECT match_id, innings_number, bowling_team, bowler, over_number, count_if(legal) AS balls, sum(charged) AS charged, count_if(credited) AS wickets, sum(extras_wides) AS wides, sum(extras_noballs) AS noballs,
 min(ball_in_over) AS first FROM flags GROUP BY ALL),
wc AS (SELECT match_id, innings_number, bowling_team, bowler, CAST(sum(balls) AS BIGINT) AS balls, CAST(sum(charged) AS BIGINT) AS conceded, CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(wides) AS BIGINT) AS wides, CAST(sum(noballs) AS BIGINT) AS noballs,
 count_if(balls >= 6 AND charged = 0) AS maidens, min(over_number * 100 + first) AS f FROM ov GROUP BY match_id, innings_number, bowling_team, bowler)
SELECT * EXCLUDE (f), CAST(row_number() OVER (PARTITION BY match_id, innings_number ORDER BY f, bowler) AS INT) AS position FROM wc""")(lambda t: i.scorecard_bowling(t.deliveries))
query("bowling_position", """SELECT match_id, innings_number, bowler, CAST(row_number() OVER (PARTITION BY match_id, innings_number ORDER BY min(over_number * 100 + ball_in_over), bowler) AS INT) AS position
FROM flags GROUP BY match_id, innings_number, bowler""")(lambda t: i.scorecard_bowling(t.deliveries).select("match_id", "innings_number", "bowler", "position"))

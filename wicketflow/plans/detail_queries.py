"""Registered queries with the full rules of audits, search, discovery and summaries. Defects come from the tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.operators import careers as c
from wicketflow.operators import directory as y
from wicketflow.operators import innings as i
from wicketflow.operators import merges as g
from wicketflow.operators import names as n
from wicketflow.operators import quality as q
from wicketflow.operators import scores as s
from wicketflow.operators import teams as o
from wicketflow.plans.innings_queries import BAT_SQL, BOWL_SQL, CARD_SQL
from wicketflow.plans.player_queries import bat, bowl, career_bat_sql, career_bowl_sql
from wicketflow.plans.score_queries import IM, impact, milli, milli_sql
from wicketflow.plans.team_queries import SIDES, TB, sides
from wicketflow.registry import query

# deliveries with no batter in some rows, negative runs, balls beyond 12 and below 1, wickets of no one, a match of no one
BAD = """, bad AS (SELECT * REPLACE (CASE WHEN over_number = 3 AND ball_in_over = 1 THEN NULL ELSE batter END AS batter, CASE WHEN over_number = 4 AND ball_in_over = 2 THEN -1 ELSE runs_total END AS runs_total, CASE WHEN match_id = 'm3' THEN 'mx' ELSE match_id END AS match_id,
 CASE WHEN over_number = 1 AND ball_in_over = 1 THEN 14 WHEN over_number = 1 AND ball_in_over = 2 THEN 0 ELSE ball_in_over END AS ball_in_over, CASE WHEN over_number % 5 = 2 THEN NULL ELSE dismissed_player END AS dismissed_player) FROM deliveries) """


def bad(t):
    d, over, ball = t.deliveries, F.col("over_number"), F.col("ball_in_over")
    return d.withColumns({
        "batter": F.when(~((over == 3) & (ball == 1)), F.col("batter")), "runs_total": F.when((over == 4) & (ball == 2), -1).otherwise(F.col("runs_total")), "match_id": F.when(F.col("match_id") == "m3", "mx").otherwise(F.col("match_id")),
        "ball_in_over": F.when((over == 1) & (ball == 1), 14).when((over == 1) & (ball == 2), 0).otherwise(ball), "dismissed_player": F.when(over % 5 != 2, F.col("dismissed_player")),
    })


RULES = {
    "null_batter": ("FAIL", "batter IS NULL"), "null_bowler": ("FAIL", "bowler IS NULL"), "negative_runs": ("FAIL", "runs_total < 0 OR runs_batter < 0"), "ball_out_of_range": ("WARN", "over_number < 0 OR ball_in_over < 1 OR ball_in_over > 12"),
    "wicket_without_player": ("WARN", "is_wicket AND dismissed_player IS NULL"), "orphan_match": ("FAIL", "match_id NOT IN (SELECT match_id FROM matches)"),
}
AUDIT = " UNION ALL ".join(f"SELECT 'deliveries' AS category, '{k}' AS \"check\", CASE WHEN n = 0 THEN 'PASS' ELSE '{status}' END AS status, n FROM (SELECT count_if({rule}) AS n FROM bad)" for k, (status, rule) in RULES.items())
AUDIT += " UNION ALL SELECT 'deliveries', 'total ' || format, 'PASS', count(*) FROM bad GROUP BY format"
query("audit_deliveries", BAD + AUDIT)(lambda t: q.audit_deliveries(bad(t), t.matches))
query("audit_summary", BAD + f"SELECT status, count(*) AS checks, CAST(sum(n) AS BIGINT) AS rows FROM ({AUDIT}) GROUP BY status")(lambda t: q.summary(q.audit_deliveries(bad(t), t.matches)))
INN = ", inn AS (SELECT DISTINCT match_id, format, CASE WHEN match_id LIKE '%11' THEN innings_number + 5 ELSE innings_number END AS innings_number FROM deliveries UNION ALL SELECT DISTINCT 'lost' || match_id, format, 1 FROM deliveries WHERE match_id LIKE '%5') "


def stray_innings(t):
    d = t.deliveries.select("match_id", "format", F.when(F.col("match_id").like("%11"), F.col("innings_number") + 5).otherwise(F.col("innings_number")).alias("innings_number")).distinct()
    return d.unionByName(t.deliveries.where("match_id like '%5'").select(F.concat(F.lit("lost"), "match_id").alias("match_id"), "format", F.lit(1).alias("innings_number")).distinct())


query("audit_innings", INN + "SELECT 'innings' AS category, 'range ' || format AS \"check\", CASE WHEN max(innings_number) > CASE WHEN format IN ('T20', 'T20I') THEN 6 ELSE 4 END THEN 'WARN' ELSE 'PASS' END AS status, count(*) AS n FROM inn GROUP BY format UNION ALL SELECT 'innings', 'orphan_match', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM inn WHERE match_id NOT IN (SELECT match_id FROM matches)")(
    lambda t: q.audit_innings(stray_innings(t), t.matches)
)
AGGS = f", {BAT_SQL}, cb AS ({career_bat_sql('player, format')}), {BOWL_SQL}, cw AS ({career_bowl_sql('bowler, format')}), mu AS (SELECT batter, bowler, format FROM flags GROUP BY ALL HAVING count_if(faced) >= 10) "
query("audit_format_isolation", AGGS + " UNION ALL ".join(f"SELECT '{k}' AS name, format, count(*) AS n FROM {v} GROUP BY format" for k, v in (("batting", "cb"), ("bowling", "cw"), ("matchups", "mu"))))(
    lambda t: q.by_format({"batting": c.career_batting(bat(t)), "bowling": c.career_bowling(bowl(t)), "matchups": c.matchups(t.deliveries)})
)
query("fix_innings_totals", "SELECT match_id, innings_number, CAST(sum(runs_total) AS BIGINT) AS runs, match_id LIKE '%9' AS fixed FROM deliveries GROUP BY ALL")(
    lambda t: q.corrected(i.innings_totals(t.deliveries).withColumn("runs", F.col("runs") + F.when(F.col("match_id").like("%9"), 5).otherwise(0)).select("match_id", "innings_number", "runs"), i.innings_totals(t.deliveries), ["match_id", "innings_number"], "runs")
)

# names and search
ACCENTS = "'Équipe ' || s_suppkey || 'ª Ñandú' "
query("norm_search_text", "SELECT s_suppkey, 'equipe ' || s_suppkey || ' nandu' AS value FROM supplier")(lambda t: t.raw("supplier").select("s_suppkey", n.search_text(F.concat(F.lit("  Équipe"), F.col("s_suppkey").cast("string"), F.lit("-Ñandú!"))).alias("value")))
query("fn_parse_int", "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS value FROM orders")(lambda t: t.raw("orders").select("o_orderkey", n.parse_int(F.concat(F.lit(" "), F.format_number("o_orderkey", 0))).cast("long").alias("value")))
query("player_registry", "SELECT player AS name, upper(player[1]) AS initials, player AS first_name FROM (SELECT batter AS player FROM deliveries UNION SELECT bowler FROM deliveries)")(
    lambda t: t.deliveries.select(F.col("batter").alias("name")).union(t.deliveries.select("bowler")).distinct().select("name", *[x for x in n.name_parts(F.col("name"))]).select("name", "initials", "first_name")
)
query("entity_discovery", "SELECT 'player' AS kind, name, CASE WHEN count(*) FILTER (role = 'b') >= 30 THEN 'bowler' ELSE 'batter' END AS role, arg_min(team, pos) AS first_team FROM (SELECT batter AS name, 'a' AS role, batting_team AS team, match_date::VARCHAR || match_id AS pos FROM deliveries UNION ALL SELECT bowler, 'b', bowling_team, match_date::VARCHAR || match_id FROM deliveries) GROUP BY name UNION ALL SELECT DISTINCT 'team', batting_team, NULL, NULL FROM deliveries UNION ALL SELECT DISTINCT 'venue', venue, NULL, NULL FROM deliveries")(
    lambda t: n.entities(t.deliveries)
)
query("season_backfill", "SELECT match_id, CASE WHEN year(match_date) = 2022 THEN 'stored ' || competition ELSE sha256(competition || '|' || year(match_date)) END AS season_id FROM matches")(
    lambda t: y.season_ids(t.matches, t.matches.where("year(match_date) = 2022").select(F.concat(F.lit("stored "), "competition").alias("id"), "competition", F.lit("2022").alias("season")).distinct())[0]
)
query("resolve_competition", "SELECT DISTINCT competition AS name, CASE WHEN competition = 'Cup 0' THEN 'known' ELSE sha256(competition) END AS id FROM matches")(
    lambda t: n.get_or_create(n.canonical(t.matches.select(F.when(F.col("competition") == "Cup 2", " CUP  two").otherwise(F.col("competition")).alias("name")), "name", t.matches.select(F.lit("cup two").alias("alias"), F.lit("Cup 2").alias("name")).distinct()), t.matches.where("competition = 'Cup 0'").select(F.lit("known").alias("id"), F.col("competition").alias("name")).distinct(), "name")
)
query("resolve_player", "SELECT DISTINCT batter AS name, CASE WHEN batter LIKE '%P1' THEN 'id of ' || batter WHEN batter LIKE '%P2' THEN 'alias of ' || batter ELSE sha256(batter) END AS id FROM deliveries")(
    lambda t: (lambda asked: n.alias_or_create(asked, asked.where("name like '%P1'").select(F.concat(F.lit("id of "), "name").alias("id"), "name"), asked.where("name like '%P2'").select(F.upper("name").alias("alias"), F.concat(F.lit("alias of "), "name").alias("id"))))(t.deliveries.select(F.col("batter").alias("name")).distinct())
)
TIERS = "CASE WHEN q.words = 'the big one' THEN 120 WHEN e.name = 'world cup' AND q.words IN ('world cup', 'wcx') THEN 110 WHEN q.words = 'wc' AND e.name = 'world cup' THEN 95 WHEN q.words IN ('orld cu', 'other league') AND contains(e.name, q.words) THEN 80 WHEN q.words = 'league other' AND e.name = 'some other league' THEN 70 END"
query("competition_search", f""", ed AS (SELECT CASE competition WHEN 'Cup 0' THEN 'world cup' WHEN 'Cup 1' THEN 'some other league' ELSE 'rest' END AS name, season, count(*) AS matches FROM matches GROUP BY 1, 2),
q AS (SELECT unnest(['the big one', 'world cup', 'wcx', 'wc', 'orld cu', 'other league', 'league other', 'up']) AS words), qs AS (SELECT words, words || CASE WHEN y = '' THEN '' ELSE ' ' || y END AS query, CASE y WHEN '' THEN NULL ELSE '2023' END AS season FROM q, (SELECT unnest(['', '23', '2023']) AS y))
SELECT query, CAST(n AS INT) AS n, id, score FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, season DESC, matches DESC, id) AS n FROM (
SELECT q.query, e.name || e.season AS id, e.season, e.matches, CAST({TIERS} + CASE WHEN q.season IS NOT NULL THEN 25 ELSE 0 END AS INT) AS score FROM qs q JOIN ed e ON (q.season IS NULL OR e.season = q.season) AND (q.words <> 'the big one' OR e.name = 'world cup')) WHERE score IS NOT NULL) WHERE n <= 5""")(
    lambda t: n.search(
        t.matches.select(F.when(F.col("competition") == "Cup 0", "World Cup").when(F.col("competition") == "Cup 1", "Some Other League").otherwise("Rest").alias("name"), "season").groupBy("name", "season").agg(F.count("*").alias("matches"))
        .select(F.concat(F.lower("name"), "season").alias("id"), "name", F.when(F.col("name") == "World Cup", "WCX").alias("short"), "season", "matches"),
        t.matches.select(F.explode(F.array(*[F.lit(f"{w}{y}") for w in ("the big one", "world cup", "wcx", "wc", "orld cu", "other league", "league other", "up") for y in ("", " 23", " 2023")])).alias("query")).distinct(),
        t.matches.select(F.lit("The Big One").alias("alias"), F.lit("World Cup").alias("name")).distinct(),
    )
)

# summaries
MEMBERS = [f"Team{k}" for k in range(5)]
query("filter_full_members", f"SELECT match_id FROM matches WHERE team_a IN {tuple(MEMBERS)} AND team_b IN {tuple(MEMBERS)}")(lambda t: o.between_members(t.matches, MEMBERS).select("match_id"))
query("team_performance", SIDES + "," + TB + """, tp AS (SELECT *, runs / matches::DOUBLE AS avg_score, CASE WHEN chases > 0 THEN chases_won * 100.0::DOUBLE / chases END AS chase_pct, CASE WHEN defences > 0 THEN defences_won * 100.0::DOUBLE / defences END AS defend_pct FROM (
 SELECT team, format, count(*) AS matches, count_if(result_type = 'win' AND winner = team) AS wins, count_if(result_type = 'win' AND winner <> team) AS losses, count_if(result_type = 'tie') AS ties, count_if(result_type = 'draw') AS draws, count_if(result_type IN ('no_result', 'abandoned')) AS no_results,
 CAST(sum(scored) AS BIGINT) AS runs, CAST(sum(allowed) AS BIGINT) AS runs_against, max(scored) AS highest, min(scored) AS lowest, count_if(chased) AS chases, count_if(chased AND result_type = 'win' AND winner = team) AS chases_won, count_if(NOT chased) AS defences, count_if(NOT chased AND result_type = 'win' AND winner = team) AS defences_won FROM sides GROUP BY ALL)),
z AS (SELECT team, format, coalesce((avg_score - min(avg_score) OVER f) / nullif(max(avg_score) OVER f - min(avg_score) OVER f, 0) * 100, 50.0) AS bs, coalesce((max(economy) OVER f - economy) / nullif(max(economy) OVER f - min(economy) OVER f, 0) * 100, 50.0) AS ws, wins * 100.0::DOUBLE / matches AS wr FROM tp LEFT JOIN tb USING (team, format) WINDOW f AS (PARTITION BY format)),
ph AS (SELECT batting_team AS team, format, """ + ", ".join(f"CAST(coalesce(sum(runs_total) FILTER (phase = '{p}'), 0) AS BIGINT) AS {p}_runs, count_if(legal AND phase = '{p}') AS {p}_balls" for p in ("powerplay", "middle", "death")) + """ FROM flags GROUP BY batting_team, format)
SELECT tp.*, ph.* EXCLUDE (team, format), 0.35::DOUBLE * bs + 0.35::DOUBLE * ws + 0.30::DOUBLE * wr AS strength FROM tp JOIN z USING (team, format) LEFT JOIN ph USING (team, format)""")(
    lambda t: o.team_summary(sides(t), t.deliveries)
)
query("tournament_overview", "SELECT competition, season, count(DISTINCT match_id) AS matches, count(DISTINCT team) AS teams, count(DISTINCT venue) AS venues, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(wickets) AS BIGINT) AS wickets, max(runs) AS highest, avg(runs) FILTER (innings_number = 1) AS avg_first FROM (SELECT match_id, venue, competition, season, innings_number, batting_team AS team, CAST(sum(runs_total) AS BIGINT) AS runs, count_if(is_wicket) AS wickets FROM deliveries GROUP BY ALL) GROUP BY competition, season")(
    lambda t: o.edition_summary(t.deliveries)
)
query("overview_counts", f", {BAT_SQL} SELECT (SELECT count(*) FROM matches) AS matches, (SELECT count(DISTINCT venue) FROM matches) AS venues, (SELECT count(DISTINCT player) FROM bl) AS batters, (SELECT string_agg(player || ':' || runs, ',' ORDER BY runs DESC, player) FROM (SELECT player, CAST(sum(runs) AS BIGINT) AS runs FROM bl GROUP BY player ORDER BY runs DESC, player LIMIT 5)) AS top_batters, (SELECT string_agg(venue || ':' || n, ',' ORDER BY n DESC, venue) FROM (SELECT venue, count(*) AS n FROM matches GROUP BY venue ORDER BY n DESC, venue LIMIT 3)) AS top_venues")(
    lambda t: t.matches.agg(F.count("*").alias("matches"), F.countDistinct("venue").alias("venues")).crossJoin(F.broadcast(t.bat_lines.agg(F.countDistinct("player").alias("batters"))))
    .crossJoin(F.broadcast(o.leading(t.bat_lines.groupBy("player").agg(r.total("runs").alias("n")), "player", 5, "top_batters"))).crossJoin(F.broadcast(o.leading(t.matches.groupBy("venue").agg(F.count("*").alias("n")), "venue", 3, "top_venues")))  # one row each
)
query("player_profile", IM + f"SELECT player, format, runs, average, wickets, economy, {milli_sql('impact')} FROM (SELECT coalesce(cb.player, cw.bowler) AS player, coalesce(cb.format, cw.format) AS format, cb.runs, cb.average, cw.wickets, cw.economy FROM cb FULL JOIN cw ON cb.player = cw.bowler AND cb.format = cw.format) LEFT JOIN im USING (player, format)")(
    lambda t: c.career_batting(t.bat_lines).select("player", "format", "runs", "average").join(c.career_bowling(t.bowl_lines).select(F.col("bowler").alias("player"), "format", "wickets", "economy"), ["player", "format"], "full")
    .join(impact(t).select("player", "format", "impact"), ["player", "format"], "left").select("player", "format", "runs", "average", "wickets", "economy", *milli("impact"))
)
query("match_detail", f", {CARD_SQL}, wk AS (SELECT match_id, innings_number, bowler, count_if(credited) AS wickets, CAST(sum(charged) AS BIGINT) AS conceded, min(over_number * 1000 + ball_in_over) AS pos FROM flags GROUP BY match_id, innings_number, bowler) SELECT match_id, venue, (SELECT string_agg(innings_number || player || runs || '(' || balls || ')', ' ' ORDER BY innings_number, position) FROM full_card f WHERE f.match_id = m.match_id) AS batting, (SELECT string_agg(innings_number || bowler || wickets || '/' || conceded, ' ' ORDER BY innings_number, pos, bowler) FROM wk w WHERE w.match_id = m.match_id) AS bowling FROM matches m")(
    lambda t: g.match_detail(t.matches.select("match_id", "venue"), i.scorecard_batting(t.deliveries), i.scorecard_bowling(t.deliveries)).select(
        "match_id", "venue", F.array_join(F.transform("batting", lambda b: F.concat(b["innings_number"].cast("string"), b["player"], b["runs"].cast("string"), F.lit("("), b["balls"].cast("string"), F.lit(")"))), " ").alias("batting"),
        F.array_join(F.transform("bowling", lambda b: F.concat(b["innings_number"].cast("string"), b["bowler"], b["wickets"].cast("string"), F.lit("/"), b["conceded"].cast("string"))), " ").alias("bowling"),
    )
)
query("data_completeness", BAD + "SELECT format, count(*) AS n, count(DISTINCT match_id) AS matches, count(batter) AS with_batter, count(bowler) AS with_bowler, count(extra_type) AS with_extra, count(fielder) AS with_fielder, count(dismissed_player) AS with_dismissed, count(venue) AS with_venue, min(match_date) AS first_date, max(match_date) AS last_date FROM bad GROUP BY format")(
    lambda t: bad(t).groupBy("format").agg(F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), *[F.count(k).alias(f"with_{v}") for k, v in (("batter", "batter"), ("bowler", "bowler"), ("extra_type", "extra"), ("fielder", "fielder"), ("dismissed_player", "dismissed"), ("venue", "venue"))], F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))
)

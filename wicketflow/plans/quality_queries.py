"""Registered queries over names and data quality. Defects come from the tables by fixed rules: some keys in capitals, some
repeated, some without a partner."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.operators import careers as c
from wicketflow.operators import directory as y
from wicketflow.operators import innings as i
from wicketflow.operators import names as n
from wicketflow.operators import quality as q
from wicketflow.plans.innings_queries import BAT_SQL, CARD_SQL
from wicketflow.plans.player_queries import bat, career_bat_sql
from wicketflow.registry import query


def scalar(name, source, column, expression, sql):
    """A scalar function over a column of a raw table."""
    query(name, f"SELECT {column} AS input, {sql} AS value FROM (SELECT DISTINCT {column} FROM {source})")(lambda t: t.raw(source).select(F.col(column).alias("input")).distinct().select("input", expression(F.col("input")).alias("value")))


SEARCH = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g'))"
scalar("fn_identity_key", "customer", "c_name", n.identity_key, "lower(regexp_replace(trim(c_name), '\\s+', ' ', 'g'))")
scalar("fn_acronym", "nation", "n_name", n.acronym, "array_to_string(list_transform(list_filter(string_split(" + SEARCH.format(c="n_name") + ", ' '), lambda w: w <> '' AND w NOT IN ('of', 'the', 'and', 'a', 'an', 'for', 'in')), lambda w: w[1]), '')")
scalar("fn_balls_to_overs", "lineitem", "l_partkey", n.balls_to_overs, "CAST(CAST(floor(l_partkey / 6.0) AS BIGINT) AS VARCHAR) || '.' || CAST(l_partkey % 6 AS VARCHAR)")
scalar("fn_rank_change", "orders", "o_orderpriority", n.rank_change, "TRY_CAST(nullif(regexp_extract(o_orderpriority, '([+-]?[0-9]+)', 1), '') AS INT)")
scalar("fn_as_bool", "lineitem", "l_linenumber", n.as_bool, "CAST(l_linenumber AS VARCHAR) IN ('true', '1', 'yes', 'y')")
query("fn_overs_to_balls", "SELECT b, b AS value FROM (SELECT DISTINCT CAST(l_partkey AS INT) AS b FROM lineitem)")(lambda t: t.raw("lineitem").select(F.col("l_partkey").cast("int").alias("b")).distinct().select("b", n.overs_to_balls(n.balls_to_overs(F.col("b"))).alias("value")))
query("fn_score_value", "SELECT DISTINCT CAST(l_quantity AS INT) AS v, CAST(l_quantity AS INT) AS value FROM lineitem")(lambda t: t.raw("lineitem").select(F.col("l_quantity").cast("int").alias("v")).distinct().select("v", n.score_value(F.concat(F.col("v").cast("string"), F.lit("*"))).alias("value")))
query("fn_bowling_figures", "SELECT DISTINCT l_linenumber AS a, CAST(l_quantity AS INT) AS b, CAST(l_linenumber AS INT) AS wickets, CAST(l_quantity AS INT) AS runs FROM lineitem")(
    lambda t: t.raw("lineitem").select(F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b")).distinct().select("a", "b", *n.bowling_figures(F.concat_ws("/", F.col("a").cast("string"), F.col("b").cast("string"))))
)
query("fn_season_sort", "SELECT DISTINCT year(o_orderdate) AS y, CAST(year(o_orderdate) AS INT) + 1 AS value FROM orders")(
    lambda t: t.raw("orders").select(F.year("o_orderdate").cast("long").alias("y")).distinct().select("y", n.season_sort(F.concat(F.lit("Season "), F.col("y").cast("string"), F.lit("/"), (F.col("y") + 1).cast("string"))).alias("value"))
)
query("fn_name_parts", "SELECT c_name AS name, string_split(c_name, ' ')[1] AS first_name, array_to_string(string_split(c_name, ' ')[2:], ' ') AS last_name, array_to_string(list_transform(string_split(c_name, ' '), lambda w: upper(w[1])), '') AS initials FROM (SELECT DISTINCT regexp_replace(trim(c_name), '\\s+', ' ', 'g') AS c_name FROM customer)")(
    lambda t: t.raw("customer").select(F.regexp_replace(F.trim("c_name"), r"\s+", " ").alias("name")).distinct().select("name", *n.name_parts(F.col("name")))
)
query("fn_year", "SELECT match_id, year(match_date) AS year FROM matches")(lambda t: t.matches.select("match_id", F.year("match_date").cast("long").alias("year")))
query("fn_safe_rate", "SELECT o_orderkey, o_totalprice / nullif(o_orderkey % 7, 0) AS rate FROM orders")(lambda t: t.raw("orders").select("o_orderkey", F.try_divide("o_totalprice", F.col("o_orderkey") % 7).alias("rate")))
query("fn_log_volume", f", {BAT_SQL} SELECT player, format, CAST(floor(ln(1 + sum(runs)) * 1e6 + 0.5) AS BIGINT) AS volume FROM bl GROUP BY ALL")(lambda t: bat(t).groupBy("player", "format").agg(F.floor(F.log1p(F.sum("runs")) * 1e6 + 0.5).cast("long").alias("volume")))
query("fn_win_margin", "SELECT match_id, CASE WHEN result_type <> 'win' THEN NULL WHEN winner = team_a THEN first_runs - second_runs ELSE 10 - second_wickets END AS margin FROM matches")(
    lambda t: t.matches.select("match_id", F.when(F.col("result_type") == "win", F.when(F.col("winner") == F.col("team_a"), F.col("first_runs") - F.col("second_runs")).otherwise(10 - F.col("second_wickets"))).alias("margin"))
)


# identity: every fifth supplier comes again in capitals under another id; aliases are the names in lower case
def dimension(t):
    base = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return base.unionByName(base.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), F.upper("name").alias("name")))


DIM = ", dim AS (SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT s_suppkey + 1000000, upper(s_name) FROM supplier WHERE s_suppkey % 5 = 0) "
query("self_duplicate_names", DIM + "SELECT lower(name) AS key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT DISTINCT id, name FROM dim) GROUP BY lower(name) HAVING count(DISTINCT id) > 1")(
    lambda t: n.duplicate_names(dimension(t)).select("key", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
)
query("match_player_name", DIM + """, asked AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) ELSE s_name END AS name FROM supplier),
ex AS (SELECT name, min(id) AS id FROM dim GROUP BY name HAVING count(DISTINCT id) = 1), p AS (SELECT lower(name) AS k, min(id) AS id FROM dim GROUP BY lower(name) HAVING count(DISTINCT id) = 1),
s AS (SELECT a.name, min(d.id) AS id FROM asked a JOIN dim d ON contains(lower(d.name), lower(a.name)) WHERE a.name NOT IN (SELECT name FROM ex) AND lower(a.name) NOT IN (SELECT k FROM p) GROUP BY a.name HAVING count(DISTINCT d.id) = 1)
SELECT asked.name, coalesce(ex.id, p.id, s.id) AS id FROM asked LEFT JOIN ex ON ex.name = asked.name LEFT JOIN p ON p.k = lower(asked.name) LEFT JOIN s ON s.name = asked.name""")(
    lambda t: n.resolve_unambiguous(t.raw("supplier").select(F.when(F.col("s_suppkey") % 3 == 0, F.lower("s_name")).otherwise(F.col("s_name")).alias("name")), dimension(t))
)
for _name, _col in (("resolve_team", "batting_team"), ("resolve_venue", "venue")):
    query(_name, f"SELECT DISTINCT {_col} AS name, CASE WHEN {_col} IN (SELECT max({_col}) FROM deliveries) THEN 'known' ELSE sha256({_col}) END AS id FROM deliveries")(
        lambda t, c=_col: n.get_or_create(t.deliveries.select(F.col(c).alias("name")), t.deliveries.agg(F.max(c).alias("name")).withColumn("id", F.lit("known")), "name").select("name", "id")
    )
query("resolve_season", "SELECT DISTINCT competition, season, CASE WHEN season = '2022' THEN 'stored ' || competition ELSE sha256(competition || '|' || season) END AS id FROM matches")(
    lambda t: n.get_or_create(t.matches.select("competition", "season"), t.matches.where("season = '2022'").select(F.concat(F.lit("stored "), "competition").alias("id"), "competition", "season").distinct(), "competition", "season").select("competition", "season", "id")
)
query("merge_identities", f", {BAT_SQL} SELECT CASE WHEN player LIKE '%P10' THEN replace(player, 'P10', 'P0') ELSE player END AS player, CAST(sum(runs) AS BIGINT) AS runs FROM bl GROUP BY ALL")(
    lambda t: n.merge_ids(bat(t), "player", bat(t).select(F.col("player").alias("from_id")).where("player like '%P10'").distinct().withColumn("to_id", F.regexp_replace("from_id", "P10$", "P0"))).groupBy("player").agg(F.sum("runs").alias("runs"))
)
query("identity_report", f", {BAT_SQL} SELECT player, string_agg(DISTINCT format, ',' ORDER BY format) AS formats FROM bl GROUP BY player HAVING count(DISTINCT format) >= 2")(
    lambda t: bat(t).groupBy("player").agg(F.sort_array(F.collect_set("format")).alias("f")).where(F.size("f") >= 2).select("player", F.array_join("f", ",").alias("formats"))
)
query("union_roles", "SELECT batter AS player, match_id FROM deliveries UNION SELECT bowler, match_id FROM deliveries")(lambda t: t.deliveries.select(F.col("batter").alias("player"), "match_id").union(t.deliveries.select("bowler", "match_id")).distinct())
query("referenced_players", "SELECT batter AS player FROM deliveries UNION SELECT bowler FROM deliveries UNION SELECT non_striker FROM deliveries UNION SELECT dismissed_player FROM deliveries WHERE dismissed_player IS NOT NULL")(
    lambda t: t.deliveries.select(F.explode(F.array("batter", "bowler", "non_striker", "dismissed_player")).alias("player")).where("player is not null").distinct()
)
query("primary_team_season", f", {BAT_SQL}, x AS (SELECT player, season, batting_team AS team, count(*) AS n, max(bl.match_date) AS last FROM bl JOIN matches USING (match_id) GROUP BY ALL) SELECT player, season, team FROM (SELECT *, row_number() OVER (PARTITION BY player, season ORDER BY n DESC, last DESC, team) AS k FROM x) WHERE k = 1")(
    lambda t: bat(t).join(t.matches.select("match_id", "season"), "match_id").groupBy("player", "season", F.col("batting_team").alias("team")).agg(F.count("*").alias("n"), F.max("match_date").alias("last"))
    .withColumn("k", F.row_number().over(c.Window.partitionBy("player", "season").orderBy(F.desc("n"), F.desc("last"), "team"))).where("k = 1").select("player", "season", "team")
)

# quality
DEFECTS = ", bad AS (SELECT * REPLACE (CASE WHEN over_number = 3 AND ball_in_over = 1 THEN NULL ELSE batter END AS batter, CASE WHEN over_number = 4 AND ball_in_over = 2 THEN -1 ELSE runs_total END AS runs_total, CASE WHEN match_id = 'm3' THEN 'mx' ELSE match_id END AS match_id) FROM deliveries) "


def bad(t):
    d, o = t.deliveries, F.col("over_number")
    return (
        d.withColumn("batter", F.when(~((o == 3) & (F.col("ball_in_over") == 1)), F.col("batter")))
        .withColumn("runs_total", F.when((o == 4) & (F.col("ball_in_over") == 2), -1).otherwise(F.col("runs_total")))
        .withColumn("match_id", F.when(F.col("match_id") == "m3", "mx").otherwise(F.col("match_id")))
    )


def check_sql(category, checks):
    return " UNION ALL ".join(f"SELECT '{category}' AS category, '{k}' AS \"check\", CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, n FROM ({v})" for k, v in checks.items())


query("audit_matches", DEFECTS + check_sql("matches", {
    "bad_format": "SELECT count(*) AS n FROM matches WHERE format NOT IN ('T20', 'T20I', 'ODI', 'Test')", "missing_team": "SELECT count(*) AS n FROM matches WHERE team_a IS NULL OR team_b IS NULL", "missing_date": "SELECT count(*) AS n FROM matches WHERE match_date IS NULL",
    "duplicate_id": "SELECT count(*) AS n FROM (SELECT match_id FROM matches GROUP BY match_id HAVING count(*) > 1)", "no_innings": "SELECT count(*) AS n FROM matches WHERE match_id NOT IN (SELECT match_id FROM bad)",
}))(lambda t: q.audit_matches(t.matches, bad(t)))
query("anti_orphans", DEFECTS + "SELECT 'deliveries' AS category, 'orphan_match' AS \"check\", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS n FROM bad WHERE match_id NOT IN (SELECT match_id FROM matches)")(
    lambda t: q.orphans(bad(t), "match_id", t.matches, "match_id", "deliveries", "orphan_match")
)
query("duplicate_sources", DEFECTS + "SELECT match_id, count(*) AS n FROM (SELECT match_id FROM matches UNION ALL SELECT match_id FROM matches WHERE match_number % 10 = 0) GROUP BY match_id HAVING count(*) > 1")(
    lambda t: t.matches.select("match_id").unionAll(t.matches.where("match_number % 10 = 0").select("match_id")).groupBy("match_id").agg(F.count("*").alias("n")).where("n > 1")
)
query("validate_rejects", DEFECTS + "SELECT CASE WHEN batter IS NULL THEN 'no batter' ELSE 'negative runs' END AS reason, count(*) AS n FROM bad WHERE batter IS NULL OR runs_total < 0 GROUP BY ALL")(lambda t: i.rejected(bad(t)).groupBy("reason").agg(F.count("*").alias("n")))
query("anti_stale_aggregates", f", {BAT_SQL} SELECT player, match_id, runs, match_id NOT IN (SELECT match_id FROM matches WHERE result_type = 'win') AS stale FROM bl")(
    lambda t: (lambda kept, stale: kept.withColumn("stale", F.lit(False)).unionByName(stale.withColumn("stale", F.lit(True))))(*y.kept_aggregates(bat(t).select("player", "match_id", "runs"), t.matches.where("result_type = 'win'")))
)
query("backfill_result_type", "SELECT match_id, CASE WHEN winner IS NOT NULL THEN 'win' WHEN format = 'Test' THEN 'draw' ELSE 'no_result' END AS result_type FROM matches")(
    lambda t: t.matches.select("match_id", F.when(F.col("winner").isNotNull(), "win").when(F.col("format") == "Test", "draw").otherwise("no_result").alias("result_type"))
)
query("table_counts", "SELECT 'deliveries' AS name, count(*) AS n FROM deliveries UNION ALL SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'players', count(*) FROM players")(
    lambda t: t.deliveries.agg(F.count("*").alias("n")).select(F.lit("deliveries").alias("name"), "n").unionByName(t.matches.agg(F.count("*").alias("n")).select(F.lit("matches").alias("name"), "n")).unionByName(t.players.agg(F.count("*").alias("n")).select(F.lit("players").alias("name"), "n"))
)
query("clamp_stats", f", {BAT_SQL}, cb AS ({career_bat_sql('player, format')}) SELECT player, format, innings, runs, innings AS not_outs, CAST(NULL AS DOUBLE) AS average FROM cb")(
    lambda t: q.clamp(c.career_batting(bat(t)).withColumn("not_outs", F.col("innings") + 3)).select("player", "format", "innings", "runs", "not_outs", "average")
)
query("sync_tables_remap", "SELECT match_id, 'X' || venue AS venue FROM matches WHERE venue <> 'V6'")(
    lambda t: q.remap(t.matches.select("match_id", "venue"), "venue", t.matches.where("venue <> 'V6'").select(F.col("venue").alias("old_id")).distinct().withColumn("new_id", F.concat(F.lit("X"), F.col("old_id"))))[0].select("match_id", "venue")
)

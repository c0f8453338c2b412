"""Registered queries over ids across stores, names, live rows, and tables kept in step with their source."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.operators import careers as c
from wicketflow.operators import directory as y
from wicketflow.operators import identity as x
from wicketflow.operators import innings as i
from wicketflow.operators import keys
from wicketflow.operators import names as n
from wicketflow.operators import quality as q
from wicketflow.operators import teams as tm
from wicketflow.plans.innings_queries import BAT_SQL, BOWL_SQL
from wicketflow.plans.player_queries import bat, bowl, career_bat_sql
from wicketflow.plans.team_queries import PERF, STRENGTH, TB, sides
from wicketflow.registry import query
from wicketflow.sources import sinks
from wicketflow.sources.shared import fresh_path, staged
from wicketflow.streaming import live as live_rows

MN = "CAST(substr(match_id, 2) AS INT)"


def number():
    """A match's number, from its id."""
    return F.substring("match_id", 2, 9).cast("int")


# names: suppliers are the dimension, orders and customers ask for them in other ways of writing
def aliases(t):
    """Short names unlike the names themselves: 's<key>' for every supplier whose key isn't divisible by 4."""
    return t.raw("supplier").where("s_suppkey % 4 <> 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("alias"), F.col("s_name").alias("name"), F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("short"))


def asking(t):
    return t.raw("lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("team")).distinct()


query("norm_team", "SELECT DISTINCT 's' || l_suppkey AS team, CASE WHEN l_suppkey % 4 <> 0 THEN s_name ELSE 's' || l_suppkey END AS team_name, CASE WHEN l_suppkey % 4 <> 0 THEN 'C' || l_suppkey ELSE upper(('s' || l_suppkey)[1:3]) END AS team_short FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")(
    lambda t: x.team_names(asking(t), "team", aliases(t))
)
query("norm_venue", "SELECT DISTINCT l_suppkey, CASE WHEN l_suppkey % 4 <> 0 THEN s_name ELSE ' s' || l_suppkey END AS venue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")(
    lambda t: n.canonical(t.raw("lineitem").select("l_suppkey").distinct().withColumn("venue", F.concat(F.lit(" s"), F.col("l_suppkey").cast("string"))), "venue", aliases(t))
)
query("norm_player", "SELECT DISTINCT l_suppkey, CASE WHEN l_suppkey % 4 <> 0 THEN s_name ELSE 's' || l_suppkey END AS batter, CASE WHEN (l_suppkey % 4) <> 0 THEN s_name ELSE 's' || l_suppkey END || ', nobody' AS eleven FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")(
    lambda t: (lambda rows: x.display_lists(F.concat("team", F.lit(" ,nobody")), aliases(t), n.canonical(rows, "batter", aliases(t)), "l_suppkey", "eleven").select("l_suppkey", "batter", "eleven"))(
        t.raw("lineitem").select("l_suppkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("team")).distinct().withColumn("batter", F.col("team"))
    )
)
query("norm_format", "SELECT match_id, CASE WHEN format = 'T20I' THEN 'T20I' ELSE format END AS format FROM matches")(
    lambda t: t.matches.select("match_id", x.format_name(F.when(F.col("format") == "T20I", "IT20").when(F.col("format") == "ODI", "odi").when(F.col("format") == "Test", "test").otherwise(F.col("format"))).alias("format"))
)
query("norm_wicket", "SELECT replace(wicket_type, ' ', '_') AS kind, count(*) AS n FROM deliveries WHERE wicket_type IS NOT NULL GROUP BY 1 UNION ALL SELECT 'obstructing_field', count(*) FROM deliveries WHERE wicket_type = 'bowled'")(
    lambda t: t.deliveries.where("wicket_type is not null").select(F.explode(F.when(F.col("wicket_type") == "bowled", F.array(F.lit("Bowled "), F.lit("Obstructing the field"))).otherwise(F.array(F.upper("wicket_type")))).alias("kind")).groupBy(x.wicket_name(F.col("kind")).alias("kind")).agg(F.count("*").alias("n"))
)
query("norm_competition", "SELECT match_id, CASE WHEN competition = 'Cup 1' THEN 'The First Cup' ELSE competition END AS competition FROM matches")(
    lambda t: n.canonical(t.matches.select("match_id", F.when(F.col("competition") == "Cup 1", F.lit("  cup   ONE ")).otherwise(F.col("competition")).alias("competition")), "competition", t.matches.select(F.lit("Cup One").alias("alias"), F.lit("The First Cup").alias("name")).distinct())
)


def batch(t):
    """A batch whose venue, six team columns and format are brought to their usual names."""
    d = t.matches.select("match_id", "venue", "team_a", "team_b", "toss_winner", "winner", "format")
    teams = t.deliveries.select(F.lower("batting_team").alias("alias"), F.regexp_replace("batting_team", "Team", "Side ").alias("name"), F.regexp_replace("batting_team", "Team", "S").alias("short")).distinct()
    d = n.canonical(d, "venue", d.select("venue").distinct().select(F.col("venue").alias("alias"), F.concat(F.lit("Ground "), "venue").alias("name")))
    for col in ("team_a", "team_b", "toss_winner", "winner"):
        d = x.team_names(d, col, teams).withColumn(col, F.col(f"{col}_name")).drop(f"{col}_name", f"{col}_short")
    return d.withColumn("format", x.format_name(F.col("format")))


query("norm_batch", "SELECT match_id, 'Ground ' || venue AS venue, replace(team_a, 'Team', 'Side ') AS team_a, replace(team_b, 'Team', 'Side ') AS team_b, replace(toss_winner, 'Team', 'Side ') AS toss_winner, replace(winner, 'Team', 'Side ') AS winner, format FROM matches")(batch)
query("fn_query_terms", "SELECT DISTINCT 'cup ' || (m % 100) || ' x ' || (m % 3) AS query, 'cup x' || CASE WHEN m % 100 < 10 THEN '' ELSE '' END AS words0, CASE WHEN m % 100 >= 10 THEN CAST(CASE WHEN m % 100 <= 50 THEN 2000 + m % 100 ELSE 1900 + m % 100 END AS VARCHAR) END AS season FROM deliveries")(
    lambda t: t.deliveries.select(F.concat(F.lit("cup "), (F.col("m") % 100).cast("string"), F.lit(" x "), (F.col("m") % 3).cast("string")).alias("query")).distinct().select("query", *x.query_terms(F.col("query"))).select("query", F.trim(F.regexp_replace(F.regexp_replace("words", " [0-9]( |$)", " "), " [0-9]$", "")).alias("words0"), "season")
)


# live rows: both teams in an array or in the older fields, innings named after a team or not, figures missing here and there
def live(t):
    m = number()
    second = F.struct(F.when((m % 5 == 0) | (m % 7 == 0), "Second Innings").otherwise(F.concat(F.lower("team_b"), F.lit(" inning 1"))).alias("inning"), F.col("second_runs").cast("int").alias("r"), F.col("second_wickets").cast("int").alias("w"), F.when(m % 4 != 0, F.lit(20.0)).alias("o"))
    first = F.struct(F.when(m % 7 == 0, "First Innings").otherwise(F.concat("team_a", F.lit(" Inning 1"))).alias("inning"), F.col("first_runs").cast("int").alias("r"), F.lit(None).cast("int").alias("w"), F.lit(19.5).alias("o"))
    named = m % 3 != 0
    return t.matches.select("match_id", "venue", F.when(named, F.array("team_a", "team_b")).alias("teams"), F.when(~named, F.col("team_a")).alias("team1"), F.when(~named, F.col("team_b")).alias("team2"), F.array(second, first).alias("score"))


TEXTS = f", lt AS (SELECT match_id, team_a, team_b, second_runs || '/' || second_wickets || CASE WHEN {MN} % 4 <> 0 THEN ' (20.0 ov)' ELSE '' END AS second, first_runs || ' (19.5 ov)' AS first FROM matches) "
query("fn_live_score_text", TEXTS + "SELECT match_id, second AS text FROM lt")(lambda t: live(t).select("match_id", x.score_text(F.get("score", 0)).alias("text")))
query("fn_team_names", "SELECT match_id, team_a, team_b FROM matches")(lambda t: live(t).select("match_id", *x.two_teams(F.col("teams"), F.col("team1"), F.col("team2"))))


def detail(t):
    rows = live(t).select("match_id", "score", *x.two_teams(F.col("teams"), F.col("team1"), F.col("team2")))
    return rows.select("match_id", "team_a", "team_b", "score", *x.scores_by_team(F.col("score"), F.col("team_a"), F.col("team_b")))


query("fn_scores_by_team", TEXTS + f"SELECT match_id, CASE WHEN {MN} % 7 = 0 THEN second ELSE first END AS score_a, CASE WHEN {MN} % 7 = 0 THEN first ELSE second END AS score_b FROM lt")(lambda t: detail(t).select("match_id", "score_a", "score_b"))


def entities(t):
    """Teams of live rows with their ids, by name."""
    t = t.stored()
    dim = t.deliveries.select("batting_team").distinct().select(F.concat(F.lit("id-"), "batting_team").alias("id"), F.upper("batting_team").alias("name"), F.regexp_replace("batting_team", "Team", "T").alias("short"))
    rows = detail(t)
    ids = staged(x.team_matches(rows.select(F.col("team_a").alias("name")).union(rows.select("team_b")), staged(dim, "teams")), "ids")
    return rows.join(ids.select(F.col("name").alias("team_a"), F.col("id").alias("team_a_id")), "team_a", "left").join(ids.select(F.col("name").alias("team_b"), F.col("id").alias("team_b_id")), "team_b", "left").select("match_id", "team_a_id", "team_b_id")


query("match_live_entities", "SELECT match_id, 'id-' || team_a AS team_a_id, 'id-' || team_b AS team_b_id FROM matches")(entities)


def live_detail(t):
    """Detail of live matches as a stream of snapshots: the last innings' score and the side that bats, by name."""
    path, out, mark = fresh_path(t.spark, "live"), fresh_path(t.spark, "detail"), fresh_path(t.spark, "mark")
    rows = live(t)
    rows.write.parquet(path)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)
    last = F.try_element_at("score", F.lit(-1))
    named = stream.select("match_id", "score", *x.two_teams(F.col("teams"), F.col("team1"), F.col("team2")))
    side = F.get(F.filter(F.array("team_a", "team_b"), lambda a: F.lower(last["inning"]).contains(F.lower(a))), F.lit(0))
    done = named.select("match_id", side.alias("batting"), x.score_text(last).alias("score")).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    done.awaitTermination()
    return t.spark.read.parquet(out)


query("stream_live_detail", TEXTS + f"SELECT match_id, CASE WHEN {MN} % 7 <> 0 THEN team_a END AS batting, first AS score FROM lt")(live_detail)


def live_ids(t):
    """Snapshots whose teams get their ids as they stream past: odd matches come before the dimension knows Team5 and renames all ids, even ones after."""
    path, dim, out, mark = (fresh_path(t.spark, k) for k in ("live", "teams", "resolved", "mark"))
    rows, names = detail(t), t.deliveries.select(F.col("batting_team").alias("name")).distinct()
    version = lambda d, sign: d.select(F.concat(F.lit(sign), "name").alias("id"), F.upper("name").alias("name"), F.lit(None).cast("string").alias("short"))

    def resolved(batch):
        teams = live_rows.dimension(batch.sparkSession, dim)
        ids = x.team_matches(batch.select(F.col("team_a").alias("name")).union(batch.select("team_b")), teams)
        return with_id(with_id(batch, "team_a", ids), "team_b", ids).select("match_id", "team_a_id", "team_b_id", "score_a")

    for odd, teams in ((1, version(names.where("name <> 'Team5'"), "old-")), (0, version(names, "new-"))):
        live_rows.publish(teams, dim)
        rows.where(number() % 2 == odd).coalesce(2).write.mode("append").parquet(path)
        live_rows.enriched(live_rows.source(t.spark, path, rows.schema, 1), resolved, out, mark).awaitTermination()
    return t.spark.read.parquet(out).select("match_id", "team_a_id", "team_b_id", "score_a")


def _versioned(team):
    return f"CASE WHEN {MN} % 2 = 0 THEN 'new-' || {team} WHEN {team} <> 'Team5' THEN 'old-' || {team} END"


query("stream_live_ids", TEXTS + f"SELECT match_id, {_versioned('team_a')} AS team_a_id, {_versioned('team_b')} AS team_b_id, CASE WHEN {MN} % 7 = 0 THEN second ELSE first END AS score_a FROM lt")(live_ids)
TEAM_DIM = "SELECT s_suppkey AS id, s_name AS name, 'c' || s_suppkey AS short FROM supplier"
query("match_team_name", f", td AS ({TEAM_DIM}), asked AS (SELECT id AS own, CASE id % 4 WHEN 0 THEN name WHEN 1 THEN short WHEN 2 THEN lower(name) ELSE name[9:] END AS name FROM td), st AS (SELECT asked.name, CASE WHEN own % 4 <> 3 THEN own ELSE (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM td WHERE contains(lower(td.name), lower(asked.name))) END AS id FROM asked) SELECT name, min(id) AS id FROM st GROUP BY name")(
    lambda t: (lambda d: x.team_matches(d.select(F.when(F.col("id") % 4 == 0, F.col("name")).when(F.col("id") % 4 == 1, F.col("short")).when(F.col("id") % 4 == 2, F.lower("name")).otherwise(F.substring("name", 9, 99)).alias("name")), d))(
        t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("short"))
    )
)


# ids of two stores: the target has every second supplier under the same id, the others under another one
def stores(t):
    source = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("Full "), "s_name").alias("full_name"))
    target = source.where("id % 10 <> 0").select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10**6).alias("id"), F.when(F.col("id") % 3 == 1, F.lit("other")).otherwise(F.upper("name")).alias("name"), F.when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.col("full_name")).alias("full_name"))
    return source, target


SAME = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 1000000 END AS t FROM supplier"
query("map_entity_ids", f"SELECT id, CASE WHEN id % 2 = 0 OR id % 3 <> 1 THEN t END AS target_id FROM ({SAME})")(lambda t: x.map_ids(*stores(t), ["name"]))
query("map_player_ids", f"SELECT id, CASE WHEN id % 2 = 1 AND id % 6 = 1 AND id % 5 <> 0 THEN NULL ELSE t END AS target_id FROM ({SAME})")(
    lambda t: (lambda s: x.map_players(*s, s[1].where("id % 5 = 0 and id < 1000000").select(F.concat(F.lit("Alias "), F.col("id").cast("string")).alias("alias"), "id").unionByName(s[0].where("id % 6 = 1 and id % 5 = 0").select(F.col("name").alias("alias"), F.when(F.col("id") % 10 != 0, F.col("id") + 10**6).alias("id")))))(stores(t))
)
def registered(t, s):
    known = x.resolver(s[1], t.raw("supplier").where("s_suppkey % 2 = 0 and s_suppkey % 10 <> 0").select(F.col("s_name").alias("alias"), F.col("s_suppkey").alias("id")))
    return s[0].select("id", n.identity_key(F.col("name")).alias("k")).join(known.withColumnRenamed("id", "target_id"), "k", "left").select("id", "target_id")


query("resolve_register_ids", f"SELECT id, CASE WHEN id % 2 = 0 OR id % 3 <> 1 THEN t END AS target_id FROM ({SAME})")(lambda t: registered(t, stores(t)))
query("map_match_ids", f"SELECT match_id AS id, CASE WHEN {MN} % 5 <> 0 THEN 'x' || match_id END AS target_id FROM matches")(
    lambda t: x.map_ids(t.matches.select(F.col("match_id").alias("id"), F.col("match_id").alias("external")), t.matches.where(number() % 5 != 0).select(F.concat(F.lit("x"), "match_id").alias("id"), F.col("match_id").alias("external")), ["external"])
)
query("map_innings_ids", f"SELECT DISTINCT match_id || '-' || innings_number AS id, CASE WHEN innings_number = 1 THEN 'y' || match_id END AS target_id FROM deliveries")(
    lambda t: (lambda inn: x.map_ids(inn.select(F.concat_ws("-", "match_id", F.col("innings_number").cast("string")).alias("id"), "match_id", "innings_number"), inn.where("innings_number = 1").select(F.concat(F.lit("y"), "match_id").alias("id"), "match_id", "innings_number"), ["match_id", "innings_number"]))(t.deliveries.select("match_id", "innings_number").distinct())
)
query("map_season_ids", "SELECT DISTINCT competition || season AS id, CASE WHEN season <> '2023' THEN 'z' || competition || season END AS target_id FROM matches")(
    lambda t: (lambda s: x.map_ids(s.select(F.concat("competition", "season").alias("id"), F.concat(F.lit("z"), "competition").alias("competition"), "season"), s.where("season <> '2023'").select(F.concat(F.lit("z"), "competition", "season").alias("id"), F.concat(F.lit("z"), "competition").alias("competition"), "season"), ["competition", "season"]))(
        t.matches.select("competition", "season").distinct()
    )
)


def dims(t):
    """Name -> id of teams, venues and players; team 5 and venue V6 aren't known."""
    d = t.deliveries
    team = d.select("batting_team").distinct().where("batting_team <> 'Team5'").select(F.col("batting_team").alias("name"), F.concat(F.lit("t:"), "batting_team").alias("id"))
    venue = d.select("venue").distinct().where("venue <> 'V6'").select(F.col("venue").alias("name"), F.concat(F.lit("v:"), "venue").alias("id"))
    player = d.select(F.col("batter").alias("name")).union(d.select("bowler")).distinct().select("name", F.concat(F.lit("p:"), "name").alias("id"))
    return {"team": team, "venue": venue, "player": player}


def with_id(rows, column, dim):
    return rows.join(dim.select(F.col("name").alias(column), F.col("id").alias(f"{column}_id")), column, "left")


query("resolve_team_ids", "SELECT match_id, CASE WHEN team_a <> 'Team5' THEN 't:' || team_a END AS team_a_id FROM matches")(lambda t: keys.with_ids(t.matches, {"team_a": (dims(t)["team"], False)})[0].select("match_id", "team_a_id"))
query("resolve_venue_ids", "SELECT match_id, CASE WHEN venue <> 'V6' THEN 'v:' || venue END AS venue_id FROM matches")(lambda t: keys.with_ids(t.matches, {"venue": (dims(t)["venue"], False)})[0].select("match_id", "venue_id"))
query("load_dimension_maps", "SELECT 'team' AS kind, count(DISTINCT batting_team) FILTER (batting_team <> 'Team5') AS n FROM deliveries UNION ALL SELECT 'venue', count(DISTINCT venue) FILTER (venue <> 'V6') FROM deliveries UNION ALL SELECT 'player', count(*) FROM (SELECT batter FROM deliveries UNION SELECT bowler FROM deliveries)")(
    lambda t: y.dimension_maps(dims(t)).groupBy("kind").agg(F.countDistinct("id").alias("n"))
)
query("new_entity_counts", "SELECT 'team' AS kind, count(DISTINCT batting_team) FILTER (batting_team = 'Team5') AS n FROM deliveries UNION ALL SELECT 'venue', count(DISTINCT venue) FILTER (venue = 'V6') FROM deliveries")(
    lambda t: y.new_entities(t.deliveries.select(F.lit("team").alias("kind"), F.col("batting_team").alias("name")).union(t.deliveries.select(F.lit("venue"), "venue")), y.dimension_maps(dims(t))).groupBy("kind").agg(F.count("*").alias("n"))
)
query("insert_required_players", "SELECT sha256(name) AS id, name FROM (SELECT DISTINCT unnest([batter, bowler, non_striker]) AS name FROM deliveries) WHERE name NOT IN (SELECT batter FROM deliveries WHERE format = 'T20' AND over_number < 4)")(
    # the stored players are those who have batted in the first overs of a T20; all others who are named are required
    lambda t: y.required_players(t.deliveries.where("format = 'T20' AND over_number < 4").select(F.concat(F.lit("p:"), "batter").alias("id"), F.col("batter").alias("name")).distinct(), t.deliveries.select(F.explode(F.array("batter", "bowler", "non_striker")).alias("name")))
)
query("record_alias", "SELECT DISTINCT 'A ' || batter AS alias, batter AS id FROM deliveries")(
    lambda t: (lambda b: sinks.unseen(b, b.where("id like '%P1'").select("alias"), ["alias"]).unionByName(b.where("id like '%P1'")))(t.deliveries.select(F.concat(F.lit("A "), "batter").alias("alias"), F.col("batter").alias("id")).distinct())
)
query("register_aliases", "SELECT DISTINCT 'A ' || batter AS alias, CASE WHEN batter LIKE '%P1' THEN 'new ' ELSE '' END || batter AS id, CASE WHEN batter LIKE '%P1' THEN 'feed' ELSE 'old' END AS source FROM deliveries")(
    lambda t: (lambda b: x.upsert_aliases(b.withColumn("source", F.lit("old")), b.where("id like '%P1'").select("alias", F.concat(F.lit("new "), "id").alias("id"), F.lit("feed").alias("source"))))(t.deliveries.select(F.concat(F.lit("A "), "batter").alias("alias"), F.col("batter").alias("id")).distinct())
)
query("remove_stale_alias_stats", f", {BAT_SQL} SELECT player, CAST(sum(runs) AS BIGINT) AS runs FROM bl WHERE player NOT LIKE '%P9' GROUP BY player")(
    # P9 of each team is an alias of P8, P7 one of itself in capitals
    lambda t: y.without_aliases(bat(t).groupBy("player").agg(r.total("runs").alias("runs")), "player", t.deliveries.where("batter LIKE '%P9' OR batter LIKE '%P7'").select(F.upper("batter").alias("alias"), F.regexp_replace("batter", "P9$", "P8").alias("name")).distinct())
)
query("join_alias_lookup", "SELECT DISTINCT l_suppkey, CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE CAST(l_suppkey AS BIGINT) END AS id FROM lineitem")(
    lambda t: y.looked_up(
        t.raw("lineitem").join(t.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_suppkey", F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("alias of "), "s_name")).otherwise(F.col("s_name")).alias("name")).distinct(), "name",
        t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), t.raw("supplier").where("s_suppkey % 8 <> 0").select(F.concat(F.lit("alias of "), "s_name").alias("alias"), F.col("s_suppkey").alias("id")),
    ).select("l_suppkey", "id")
)
query("semi_exists_alias", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 <> 0 AND CAST(s_suppkey AS VARCHAR) LIKE '%7%'")(lambda t: t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).join(aliases(t).where("lower(alias) like '%7%'"), "name", "left_semi").select("id"))
query("self_initial_expansion", "SELECT 'T' || t || ' P' || p AS short, 'Team' || t || ' P' || p AS long FROM (SELECT DISTINCT regexp_extract(batter, 'T([0-9]+)P', 1) AS t, regexp_extract(batter, 'P([0-9]+)$', 1) AS p FROM deliveries)")(
    lambda t: (lambda parts: n.initial_pairs(parts.select(F.concat(F.lit("T"), "t", F.lit(" P"), "p").alias("name")).unionByName(parts.select(F.concat(F.lit("Team"), "t", F.lit(" P"), "p").alias("name")))).where(F.regexp_extract("short", "([0-9]+) ", 1) == F.regexp_extract("long", "([0-9]+) ", 1)))(
        # written once: else every side of the pairs derives all balls again, and asks the names' conditions of each ball
        staged(t.deliveries.select("batter").distinct().select(F.regexp_extract("batter", "T([0-9]+)P", 1).alias("t"), F.regexp_extract("batter", "P([0-9]+)$", 1).alias("p")).distinct(), "parts")
    )
)


def doubtful(t):
    """Every name asked for and whom it means, null where that is in doubt.

    Every fifth player shares a name with another one; of these names every second has an alias, every third of those two.
    """
    s = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    other = F.col("id") + 10**6
    players = s.withColumn("full_name", F.lit(None).cast("string")).unionByName(s.where("id % 5 = 0").select(other.alias("id"), F.upper("name").alias("name"), F.lit("shared").alias("full_name")))
    aliases = s.where("id % 10 = 0").select(F.upper("name").alias("alias"), other.alias("id")).unionByName(s.where("id % 30 = 0").select(F.col("name").alias("alias"), "id"))
    asked = players.select(F.explode(F.array("name", "full_name")).alias("name")).select(n.identity_key(F.col("name")).alias("k")).where("k is not null").distinct()
    return asked.join(x.resolver(players, aliases), "k", "left")


query("resolve_player_unambiguous", "SELECT lower(s_name) AS k, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey WHEN s_suppkey % 10 = 0 AND s_suppkey % 30 <> 0 THEN s_suppkey + 1000000 END AS id FROM supplier UNION ALL SELECT 'shared', CASE WHEN count(*) = 1 THEN min(s_suppkey) + 1000000 END FROM supplier WHERE s_suppkey % 5 = 0 HAVING count(*) > 0")(doubtful)


def competitions(t):
    comp = t.matches.select(F.col("competition").alias("id"), F.col("competition").alias("name")).distinct()
    season = t.matches.groupBy("competition", "season").agg(F.min("match_date").alias("starts")).select(F.concat("competition", "season").alias("id"), F.col("competition").alias("competition_id"), F.col("season").alias("name"), "starts")
    return x.merge_competitions(comp, season, comp.where("id = 'Cup 2'").select(F.col("id").alias("from_id"), F.lit("Cup 0").alias("to_id")))


query("merge_competitions", "SELECT CASE WHEN competition = 'Cup 2' THEN 'Cup 0' ELSE competition END AS competition_id, season AS name, min(match_date) AS starts FROM matches GROUP BY 1, 2")(lambda t: competitions(t)[1].select("competition_id", "name", "starts"))

# rows with names in place of keys
query("join_fk_names", "SELECT match_id, 'n:' || team_a AS team_a, 'n:' || team_b AS team_b, 'n:' || venue AS venue, 'n:' || winner AS winner FROM matches")(
    lambda t: (lambda d, v: d.join(v["team"].select(F.col("id").alias("team_a_id"), F.col("shown").alias("a")), "team_a_id", "left").join(v["team"].select(F.col("id").alias("team_b_id"), F.col("shown").alias("b")), "team_b_id", "left").join(v["team"].select(F.col("id").alias("winner_id"), F.col("shown").alias("w")), "winner_id", "left").join(v["venue"].select(F.col("id").alias("venue_id"), F.col("shown").alias("v")), "venue_id", "left").select("match_id", F.col("a").alias("team_a"), F.col("b").alias("team_b"), F.col("v").alias("venue"), F.col("w").alias("winner")))(
        t.matches.select("match_id", *[F.concat(F.lit("#"), k).alias(f"{k}_id") for k in ("team_a", "team_b", "winner", "venue")]),
        {k: t.deliveries.select(F.col(col).alias("name")).distinct().select(F.concat(F.lit("#"), "name").alias("id"), F.concat(F.lit("n:"), "name").alias("shown")) for k, col in (("team", "batting_team"), ("venue", "venue"))},
    )
)
query("denormalise_deliveries", "SELECT match_id, innings_number, over_number, ball_in_over, format, match_date, venue, batting_team, bowling_team, batter, bowler, non_striker, dismissed_player, runs_total, winner FROM deliveries JOIN (SELECT match_id, winner FROM matches) USING (match_id)")(
    lambda t: i.denormalised(
        t.deliveries.select(F.concat("match_id", F.lit("/"), F.col("innings_number").cast("string")).alias("innings_id"), "over_number", "ball_in_over", *[F.concat(F.lit("p:"), k).alias(f"{k}_id") for k in ("batter", "bowler", "non_striker", "dismissed_player")], "runs_total"),
        t.deliveries.select(F.concat("match_id", F.lit("/"), F.col("innings_number").cast("string")).alias("id"), "match_id", "innings_number", F.concat(F.lit("t:"), "batting_team").alias("batting_team_id"), F.concat(F.lit("t:"), "bowling_team").alias("bowling_team_id")).distinct(),
        t.matches.select("match_id", "format", "match_date", F.concat(F.lit("v:"), "venue").alias("venue_id"), F.concat(F.lit("t:"), "winner").alias("winner_id")),
        t.deliveries.select(F.explode(F.array("batter", "bowler", "non_striker", "dismissed_player")).alias("name")).where("name is not null").distinct().select("name", F.concat(F.lit("p:"), "name").alias("id")),
        t.deliveries.select(F.col("batting_team").alias("name")).distinct().select("name", F.concat(F.lit("t:"), "name").alias("id")), t.deliveries.select(F.col("venue").alias("name")).distinct().select("name", F.concat(F.lit("v:"), "name").alias("id")),
    )
)

# tables that are kept in step
KEY = ["match_id", "innings_number"]
query("upsert_matches", "SELECT match_id, first_runs, CASE WHEN winner IS NULL THEN NULL WHEN winner = team_a THEN 'runs' ELSE 'wickets' END AS win_type FROM matches WHERE season <> '2022'")(
    lambda t: sinks.unseen(tm.match_results(tm.match_totals(t.deliveries)).drop("winner", "win_type").join(t.matches.select("match_id", "winner"), "match_id").withColumn("win_type", F.when(F.col("winner").isNull(), None).when(F.col("winner") == F.col("team_a"), "runs").otherwise("wickets")), t.matches.where("season = '2022'").select("match_id"), ["match_id"]).select("match_id", "first_runs", "win_type")
)
query("upsert_innings", "SELECT match_id, innings_number, CAST(sum(runs_total) AS BIGINT) AS runs, count_if(legal) AS balls FROM flags WHERE NOT (innings_number = 1 AND match_id LIKE '%2') GROUP BY ALL")(
    lambda t: sinks.unseen(i.innings_totals(t.deliveries), t.deliveries.where("innings_number = 1 and match_id like '%2'").select(*KEY).distinct(), KEY).select(*KEY, "runs", "balls")
)
query("upsert_affiliations", "SELECT * FROM (SELECT DISTINCT batter AS player, batting_team AS team, format FROM deliveries UNION SELECT bowler, bowling_team, format FROM deliveries) WHERE format <> 'Test'")(
    lambda t: (lambda a: sinks.unseen(a, a.where("format = 'Test'"), ["player", "team", "format"]))(t.deliveries.select(F.col("batter").alias("player"), F.col("batting_team").alias("team"), "format").union(t.deliveries.select("bowler", "bowling_team", "format")).distinct())
)


def appended(t):
    """Rows appended where their key isn't there yet: the second append adds nothing."""
    path, d = fresh_path(t.spark, "table"), t.deliveries.select(*i.EVENT, "runs_total")
    d.where("innings_number = 1").write.parquet(path)
    for _ in range(2):
        sinks.append_unseen(d, t.spark.read.parquet(path), path, i.EVENT)
    return t.spark.read.parquet(path)


query("sink_table_bulk", f"SELECT {', '.join(i.EVENT)}, runs_total FROM deliveries")(appended)
query("sync_dimension_updates", f"SELECT match_id, CASE WHEN {MN} % 6 = 3 THEN 'new ' || competition ELSE 'old' END AS competition, CASE WHEN {MN} % 3 = 0 THEN season ELSE '1900' END AS season FROM matches")(
    lambda t: y.updated(t.matches.select("match_id", F.lit("old").alias("competition"), F.lit("1900").alias("season")), t.matches.where(number() % 3 == 0).select("match_id", F.when(number() % 2 == 1, F.concat(F.lit("new "), "competition")).alias("competition"), "season"), ["match_id"], ["competition", "season"])
)
query("sync_season_dimensions", "SELECT competition, season, min(match_date) AS starts FROM matches GROUP BY competition, season")(
    lambda t: (lambda s: q.synced(s.where("season <> '2024'").withColumn("starts", F.when(F.col("season") == "2023", F.date_sub("starts", 3)).otherwise(F.col("starts"))), s, ["competition", "season"]))(t.matches.groupBy("competition", "season").agg(F.min("match_date").alias("starts")))
)


query("purge_matches", "SELECT 'deliveries' AS name, count(*) AS n FROM deliveries WHERE match_id NOT IN (SELECT match_id FROM matches WHERE match_number % 10 = 1) UNION ALL SELECT 'matches', count(*) FROM matches WHERE match_number % 10 <> 1")(
    lambda t: (lambda gone: q.table_sizes({k: df.join(gone, "match_id", "left_anti") for k, df in (("deliveries", t.deliveries), ("matches", t.matches))}))(t.matches.where("match_number % 10 = 1").select("match_id"))
)
query("team_reconcile", "SELECT team, format, count(*) AS matches, count_if(winner = team) AS wins, CASE WHEN team = 'Team1' THEN count(*) + 2 ELSE count(*) END AS stored FROM (SELECT unnest([team_a, team_b]) AS team, format, winner FROM matches) GROUP BY team, format HAVING team = 'Team1'")(
    lambda t: (lambda own: q.differing(own.withColumn("matches", F.col("matches") + F.when(F.col("team") == "Team1", 2).otherwise(0)), own, ["team", "format"], "matches").select("team", "format", F.col("expected").alias("matches"), F.col("matches").alias("stored")).join(own.select("team", "format", "wins"), ["team", "format"]))(
        t.matches.select(F.explode(F.array("team_a", "team_b")).alias("team"), "format", "winner").groupBy("team", "format").agg(F.count("*").alias("matches"), r.count_if(F.col("winner") == F.col("team")).alias("wins"))
    )
)
query("venue_reconcile", "SELECT venue, format, CAST(sum(first_runs) AS BIGINT) AS first_runs, CAST(sum(first_runs) AS BIGINT) + 10 AS stored FROM matches WHERE venue = 'V2' GROUP BY venue, format")(
    lambda t: (lambda own: q.differing(own.withColumn("first_runs", F.col("first_runs") + F.when(F.col("venue") == "V2", 10).otherwise(0)), own, ["venue", "format"], "first_runs").select("venue", "format", F.col("expected").alias("first_runs"), F.col("first_runs").alias("stored")))(
        t.matches.groupBy("venue", "format").agg(r.total("first_runs").alias("first_runs"))
    )
)

# teams and players
AFF = ", aff AS (SELECT player, team, format, count(*) AS balls, max(match_date) AS last FROM (SELECT batter AS player, batting_team AS team, format, match_date FROM deliveries UNION ALL SELECT bowler, bowling_team, format, match_date FROM deliveries) GROUP BY player, team, format) "


query("player_affiliations", AFF + "SELECT player, team, format, last, CAST(row_number() OVER (PARTITION BY player ORDER BY last DESC, team, format) AS INT) AS n FROM aff")(lambda t: y.listed_affiliations(y.affiliations(t.deliveries)))
query("display_team", AFF + "SELECT player, team FROM (SELECT player, team, row_number() OVER (PARTITION BY player ORDER BY CASE WHEN format = 'T20' THEN 0 ELSE 1 END, last DESC, balls DESC, team) AS k FROM aff) WHERE k = 1")(lambda t: y.display_teams(y.affiliations(t.deliveries)))
query("primary_team_national", AFF + "SELECT player, team FROM (SELECT player, team, row_number() OVER (PARTITION BY player ORDER BY count(DISTINCT format) DESC, sum(balls) DESC, team) AS k FROM aff WHERE format <> 'T20' GROUP BY player, team) WHERE k = 1")(lambda t: y.national_teams(y.affiliations(t.deliveries)))
query("competition_detail", "SELECT competition, string_agg(season || ':' || n, ',' ORDER BY season) AS seasons FROM (SELECT competition, season, count(*) AS n FROM matches GROUP BY competition, season) GROUP BY competition")(
    lambda t: y.competition_details(t.matches).select("competition", F.array_join(F.transform("seasons", lambda v: F.concat(v["season"], F.lit(":"), v["n"].cast("string"))), ",").alias("seasons"))
)
query("concat_activity", f", {BAT_SQL}, {BOWL_SQL} SELECT player, format, match_id FROM bl UNION SELECT bowler, format, match_id FROM wl")(lambda t: y.activity(bat(t), bowl(t)))
query("recent_impact_inputs", f""", {BAT_SQL}, {BOWL_SQL}, u AS (SELECT player, format, match_id, match_date, 1 AS bat, runs, balls, 0 AS bowl, 0 AS wickets, 0 AS bowled, 0 AS conceded FROM bl UNION ALL SELECT bowler, format, match_id, match_date, 0, 0, 0, 1, wickets, balls, conceded FROM wl)
SELECT player, format, count(DISTINCT match_id) AS matches, CAST(sum(bat) AS BIGINT) AS batting_innings, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(bowl) AS BIGINT) AS bowling_innings, CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(conceded) AS BIGINT) AS runs_conceded, max(match_date) AS last_match_date FROM u WHERE match_date >= (SELECT max(match_date) - 548 FROM u) GROUP BY player, format""")(
    lambda t: c.recent_stats(t.bat_lines, t.bowl_lines).select("player", "format", "matches", "batting_innings", "runs", "bowling_innings", "wickets", "runs_conceded", "last_match_date")
)
query("chunk_merge_test", f", {BAT_SQL}, ch AS ({career_bat_sql('player, format, innings_number')}) SELECT player, format, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(runs) AS BIGINT) AS runs FROM ch WHERE format = 'Test' GROUP BY player, format")(
    lambda t: c.career_batting(bat(t).where("format = 'Test'"), ("player", "format", "innings_number")).groupBy("player", "format").agg(r.total("matches").alias("matches"), r.total("runs").alias("runs"))
)
query("venue_player_performance", f", {BAT_SQL} SELECT venue, format, player, runs, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY venue, format ORDER BY runs DESC, player) AS INT) AS n FROM (SELECT venue, format, player, CAST(sum(runs) AS BIGINT) AS runs FROM bl GROUP BY ALL)) WHERE n <= 5")(lambda t: y.venue_players(bat(t)))
for _by in ("arm", "pace_spin"):
    _case = {"arm": "CASE WHEN bowling_style LIKE 'left%' THEN 'left' ELSE 'right' END", "pace_spin": "CASE WHEN bowling_style LIKE '%fast%' THEN 'pace' ELSE 'spin' END"}[_by]
    query({"arm": "join_bowler_arm", "pace_spin": "join_bowler_type"}[_by], f"SELECT {_case} AS kind, count(*) AS balls, count(DISTINCT bowler) AS bowlers FROM deliveries JOIN players ON bowler = player GROUP BY 1")(
        lambda t, k=_by: t.deliveries.join(t.players.select(F.col("player").alias("bowler"), *c.style_class()), "bowler", "left").groupBy(F.col(k).alias("kind")).agg(F.count("*").alias("balls"), F.countDistinct("bowler").alias("bowlers")).where("kind is not null")
    )
query("proj_phase_ranges", "SELECT phase, format, count(*) AS balls FROM flags GROUP BY phase, format")(lambda t: i.by_ranges(t.deliveries).groupBy("phase", "format").agg(F.count("*").alias("balls")))
query("clamp_not_outs", f", {BAT_SQL}, cb AS ({career_bat_sql('player, format')}) SELECT player, CAST(least(greatest(sum(not_outs + 3 - runs % 9), 0), sum(innings)) AS BIGINT) AS not_outs FROM cb GROUP BY player")(
    lambda t: c.career_batting(bat(t)).groupBy("player").agg(q.safe_not_outs(F.col("innings"), F.col("not_outs") + 3 - F.col("runs") % 9).alias("not_outs"))
)


def strengths(t):
    return tm.team_strength(tm.team_performance(sides(t)), tm.team_bowling(t.deliveries))


query("join_team_summary", PERF + f", {TB}, {STRENGTH} SELECT team, format, matches, strength FROM (SELECT team, format, count(*) AS matches FROM sides GROUP BY team, format) LEFT JOIN (SELECT * FROM st WHERE team <> 'Team3') USING (team, format)")(
    lambda t: y.with_summary(tm.team_records(sides(t), "format").select("team", "format", "matches"), strengths(t).where("team <> 'Team3'")).select("team", "format", "matches", "strength")
)
query("official_leaders", f", {BAT_SQL}, lead AS (SELECT competition, season, player, runs, row_number() OVER (PARTITION BY competition, season ORDER BY runs DESC, player) AS k FROM (SELECT competition, season, player, CAST(sum(runs) AS BIGINT) AS runs FROM bl JOIN matches USING (match_id) GROUP BY ALL)) SELECT competition, season, CASE WHEN season = '2023' THEN 'ref ' || competition ELSE player END AS player, CASE WHEN season = '2023' THEN 990 + CAST(right(competition, 1) AS BIGINT) ELSE runs END AS runs FROM lead WHERE k = 1")(
    lambda t: y.leaders(bat(t), t.matches, t.matches.where("season = '2023'").select("competition", "season").distinct().select("competition", "season", F.concat(F.lit("ref "), "competition").alias("player"), (F.lit(990) + F.substring("competition", -1, 1).cast("long")).alias("runs")))
)
query("ranking_feed", "SELECT s_suppkey AS id, CAST(s_suppkey - s_suppkey % 2 AS INT) AS rank, CAST(s_suppkey * 1000 AS INT) AS rating FROM supplier")(
    lambda t: x.ranking_rows(t.raw("supplier").select(F.col("s_suppkey").alias("at"), F.lit("all").alias("list"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise("=").alias("rank"), F.lower("s_name").alias("name"), F.format_number(F.col("s_suppkey") * 1000, 0).alias("rating")), t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("short")))
)
query("team_profile", PERF + f", {TB}, {STRENGTH}, n AS (SELECT team, format, count(*) AS matches, count_if(result_type = 'win' AND winner = team) AS wins FROM sides GROUP BY team, format) SELECT team, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(wins) AS BIGINT) AS wins, sum(strength * matches) / sum(matches) AS strength FROM n JOIN st USING (team, format) GROUP BY team")(
    lambda t: y.team_profiles(tm.team_records(sides(t), "format"), strengths(t))
)

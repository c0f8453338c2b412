"""Registered queries over full and official careers, preparation of documents, cards and their audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.operators import directory as y
from wicketflow.operators import innings as i
from wicketflow.operators import merges
from wicketflow.operators import quality as q
from wicketflow.operators import records as rec
from wicketflow.plans.innings_queries import BAT_SQL, BOWL_SQL, CARD_SQL
from wicketflow.plans.player_queries import career_bat_sql, career_bowl_sql
from wicketflow.operators.identity import resolver
from wicketflow.registry import query
from wicketflow.sources import matches as m
from wicketflow.sources import sinks
from wicketflow.sources.shared import fresh_path, staged

PH = rec.PHASES


def rate(part: str, whole: str, times: int = 1) -> str:
    return f"CASE WHEN {whole} > 0 THEN {part} * {times}.0::DOUBLE / {whole} END"


def total(expression: str) -> str:
    return f"CAST(coalesce(sum({expression}), 0) AS BIGINT)"


# full careers
FULL = f"""cf0 AS (SELECT format, match_id, innings_number, batter AS player, runs_batter AS runs, faced, faced AND runs_total = 0 AS dot, four, six, phase, 1 AS strikes, false AS gone FROM flags WHERE batter <> ''
 UNION ALL SELECT format, match_id, innings_number, dismissed_player, 0, false, false, false, false, '', 0, true FROM flags WHERE dismissed AND dismissed_player IS NOT NULL),
cf1 AS (SELECT format, match_id, innings_number, player, sum(runs) AS runs, count_if(faced) AS balls, count_if(dot) AS dots, count_if(four) AS fours, count_if(six) AS sixes, max(strikes) = 1 AS bats, bool_or(gone) AS gone,
 {", ".join(f"{total(f'runs) FILTER (phase = {chr(39)}{p}{chr(39)}')} AS {p}_runs, count_if(faced AND phase = '{p}') AS {p}_balls" for p in PH)} FROM cf0 GROUP BY format, match_id, innings_number, player),
cf2 AS (SELECT player, format, count(DISTINCT match_id) FILTER (bats) AS matches, count_if(bats) AS innings, {", ".join(f"{total(c)} AS {c}" for c in ("runs", "balls", "dots", "fours", "sixes"))}, least(count_if(gone), count_if(bats)) AS dismissals, CAST(max(runs) FILTER (bats) AS BIGINT) AS highest,
 count_if(bats AND runs BETWEEN 50 AND 99) AS fifties, count_if(bats AND runs >= 100) AS hundreds, {", ".join(f"{total(f'{p}_{c}')} AS {p}_{c}" for p in PH for c in ("runs", "balls"))},
 {", ".join(f"{total(f'{c}) FILTER (innings_number = {n}')} AS {s}_{c}" for s, n in (("first", 1), ("chasing", 2)) for c in ("runs", "balls"))}, avg(runs) FILTER (bats) AS mean, stddev_samp(runs) FILTER (bats) AS deviation FROM cf1 GROUP BY player, format),
cf AS (SELECT * EXCLUDE (mean, deviation), innings - dismissals AS not_outs, coalesce({rate("runs", "dismissals")}, runs::DOUBLE) AS average, {rate("runs", "balls", 100)} AS strike_rate, {rate("(fours + sixes)", "balls", 100)} AS boundary_pct, {rate("dots", "balls", 100)} AS dot_pct,
 {", ".join(f"{rate(f'{p}_runs', f'{p}_balls', 100)} AS {p}_strike_rate" for p in (*PH, "first", "chasing"))}, CASE WHEN innings >= 5 THEN greatest(0, (1 - deviation / greatest(mean, 0.01)) * 100) END AS consistency FROM cf2 WHERE innings > 0)"""
FULL_C = [f"{p}_{c}" for p in PH for c in ("runs", "balls", "strike_rate")] + ["first_runs", "first_balls", "first_strike_rate", "chasing_runs", "chasing_balls", "chasing_strike_rate"]
BAT_C = ["player", "format", "matches", "innings", "not_outs", "runs", "highest", "average", "strike_rate", "balls", "fours", "sixes", "boundary_pct", "dot_pct", "fifties", "hundreds", *FULL_C]


def even(t):
    """consistency to 1e-6: its deviation differs in the last bits between engines."""
    return F.floor(F.col("consistency") * 1e6 + 0.5).cast("long").alias("consistency")


EVEN = "CAST(floor(consistency * 1e6 + 0.5) AS BIGINT) AS consistency"
query("career_batting_full", f", {FULL} SELECT {', '.join(BAT_C)}, {EVEN} FROM cf")(lambda t: rec.career_batting_full(t.deliveries).select(*BAT_C, even(t)))
BOWL_C = ["player", "format", "matches", "innings", "balls", "wickets", "conceded", "dots", "boundaries", *[f"{p}_{c}" for p in PH for c in ("runs", "balls", "wickets")]]
RATES = {"economy": rate("conceded", "balls", 6), "average": rate("conceded", "wickets"), "strike_rate": rate("balls", "wickets"), "dot_pct": rate("dots", "balls", 100), "boundary_pct": rate("boundaries", "balls", 100)} | {f"{p}_economy": rate(f"{p}_runs", f"{p}_balls", 6) for p in PH}
query("career_bowling_full", f"""SELECT {', '.join(BOWL_C)}, {', '.join(f'{v} AS {k}' for k, v in RATES.items())} FROM (SELECT bowler AS player, format, count(DISTINCT match_id) AS matches, count(DISTINCT match_id || '/' || innings_number) AS innings, count_if(legal) AS balls, {total('charged')} AS conceded,
count_if(credited) AS wickets, count_if(legal AND runs_total = 0) AS dots, count_if(four OR six) AS boundaries, {', '.join(f"{total(f'charged) FILTER (phase = {chr(39)}{p}{chr(39)}')} AS {p}_runs, count_if(legal AND phase = '{p}') AS {p}_balls, count_if(credited AND phase = '{p}') AS {p}_wickets" for p in PH)} FROM flags GROUP BY bowler, format)""")(
    lambda t: rec.career_bowling_full(t.deliveries).select(*BOWL_C, *RATES)
)


def repaired(t):
    """One format's careers are rebuilt from the deliveries; the other formats' stored rows stay as they are."""
    path, good = fresh_path(t.spark, "careers"), rec.career_batting_full(t.deliveries).select("player", "format", "innings", "runs")
    good.withColumn("runs", F.col("runs") + 1).write.partitionBy("format").parquet(path)
    sinks.replace_formats(good.where("format = 'ODI'"), path, ["player", "format"])
    return t.spark.read.schema(good.schema).parquet(path).select("player", "format", "innings", "runs")


query("repair_batting", f", {FULL} SELECT player, format, innings, runs + CASE WHEN format = 'ODI' THEN 0 ELSE 1 END AS runs FROM cf")(repaired)


# documents with named elevens, registers and what preparation looks at
def squad(team):
    k = F.regexp_extract(team, "([0-9]+)$", 1)
    return F.transform(F.sequence(F.lit(0), F.lit(10)), lambda p: F.concat(F.lit("T"), k, F.lit("P"), p.cast("string")))


def rich(t):
    """Match documents with elevens, a register of ids, gender and type of team, as JSON in the shared folder."""
    path, teams, n = fresh_path(t.spark, "documents"), F.col("info.teams"), F.substring("match_id", 2, 9).cast("int")
    elevens = F.transform(teams, squad)
    info = F.col("info").withField("players", F.map_from_arrays(teams, elevens)).withField("gender", F.when(n % 5 == 0, "female").otherwise("male")).withField("team_type", F.when(n % 3 == 0, "international").otherwise("club"))
    info = info.withField("registry", F.struct(F.map_from_arrays(F.flatten(elevens), F.transform(F.flatten(elevens), lambda x: F.concat(F.lit("id-"), x))).alias("people")))
    info = info.withField("outcome", F.struct(F.when(n % 7 > 2, F.get(teams, 0)).alias("winner"), F.when(n % 7 == 0, "tie").when(n % 7 == 1, "No Result").alias("result")))
    docs = m.as_documents(t.deliveries).withColumn("info", info)
    docs.withColumn("innings", F.when(n % 11 != 0, F.col("innings"))).write.json(path, compression="gzip")
    return path


def read_rich(t):
    return t.spark.read.schema(m._DDL).json(rich(t))


MN = "CAST(substr(match_id, 2) AS INT)"
WITH_INNINGS = f"{MN} % 11 <> 0"
SQUADS = f", ap AS (SELECT DISTINCT 'T' || regexp_extract(team, '([0-9]+)$', 1) || 'P' || p AS player, format, match_id FROM (SELECT match_id, format, unnest([team_a, team_b]) AS team FROM matches), range(11) AS x(p)), "
OB = f"""{CARD_SQL}, ocard AS (SELECT full_card.*, format FROM full_card JOIN matches USING (match_id) WHERE {WITH_INNINGS}),
oc AS (SELECT player, format, count(*) AS innings, count_if(not_out) AS not_outs, {", ".join(f"{total(c)} AS {c}" for c in ("runs", "balls", "fours", "sixes"))}, max(runs) AS highest, count_if(runs BETWEEN 50 AND 99) AS fifties, count_if(runs >= 100) AS hundreds,
 {", ".join(f"{total(f'{c}) FILTER (innings_number = {n}')} AS {s}_{c}" for s, n in (("first", 1), ("chasing", 2)) for c in ("runs", "balls"))} FROM ocard GROUP BY player, format),
od AS (SELECT batter AS player, format, count_if(faced AND runs_total = 0) AS dots, {", ".join(f"{total(f'runs_batter) FILTER (phase = {chr(39)}{p}{chr(39)}')} AS {p}_runs, count_if(faced AND phase = '{p}') AS {p}_balls" for p in PH)} FROM flags WHERE {WITH_INNINGS} GROUP BY batter, format)"""
OB_SUMS = ["matches", "innings", "not_outs", "runs", "balls", "fours", "sixes", "fifties", "hundreds", "first_runs", "first_balls", "chasing_runs", "chasing_balls", "dots", *[f"{p}_{c}" for p in PH for c in ("runs", "balls")]]
OB_SELECT = f"SELECT *, {rate('runs', '(innings - not_outs)')} AS average, {rate('runs', 'balls', 100)} AS strike_rate FROM (SELECT player, format, highest, {', '.join(f'coalesce({c}, 0) AS {c}' for c in OB_SUMS)} FROM (SELECT player, format, count(*) AS matches FROM ap GROUP BY player, format) FULL JOIN oc USING (player, format) LEFT JOIN od USING (player, format))"


query("official_batting", SQUADS + OB + OB_SELECT)(lambda t: rec.official_batting(read_rich(t)).select("player", "format", "highest", *OB_SUMS, "average", "strike_rate"))
OB_PHASE = ", ".join(f"{total(f'balls) FILTER (phase = {chr(39)}{p}{chr(39)}')} AS {p}_balls, {total(f'charged) FILTER (phase = {chr(39)}{p}{chr(39)}')} AS {p}_runs, {total(f'wickets) FILTER (phase = {chr(39)}{p}{chr(39)}')} AS {p}_wickets" for p in PH)
OW_PHASE = [f"{p}_{c}" for p in PH for c in ("balls", "runs", "wickets")]
OW_OVERS = f"SELECT format, match_id, innings_number, bowler, over_number, phase, count_if(legal) AS balls, sum(charged) AS charged, count_if(credited) AS wickets, count_if(legal AND runs_total = 0) AS dots, count_if(four OR six) AS boundaries FROM flags WHERE {WITH_INNINGS} GROUP BY ALL"
OW_LINES = f"SELECT format, match_id, innings_number, bowler, {', '.join(f'{total(c)} AS {a}' for c, a in (('balls', 'balls'), ('charged', 'conceded'), ('wickets', 'wickets'), ('dots', 'dots'), ('boundaries', 'boundaries')))}, count_if(balls >= 6 AND charged = 0) AS maidens FROM ov GROUP BY ALL"
OW_SUMS = ["balls", "conceded", "wickets", "maidens", "dots", "boundaries"]
OW = f""", ov AS ({OW_OVERS}), ln AS ({OW_LINES}), ow AS (SELECT bowler AS player, format, count(DISTINCT match_id) AS matches, count(*) AS innings, {", ".join(f"{total(c)} AS {c}" for c in OW_SUMS)}, count_if(wickets = 4) AS fours_w, count_if(wickets >= 5) AS fives_w,
 max(wickets) || '/' || (min(conceded - 100000 * wickets) + 100000 * max(wickets)) AS best_figures FROM ln GROUP BY bowler, format),
op AS (SELECT bowler AS player, format, {OB_PHASE} FROM ov GROUP BY bowler, format)"""
OW_COLUMNS = ["player", "format", "matches", "innings", *OW_SUMS, "fours_w", "fives_w", "best_figures", *OW_PHASE]
query("official_bowling", OW + f" SELECT {', '.join(c if c not in OW_PHASE else f'coalesce({c}, 0) AS {c}' for c in OW_COLUMNS)}, {rate('conceded', 'balls', 6)} AS economy, {rate('conceded', 'wickets')} AS average, {rate('balls', 'wickets')} AS strike_rate, {rate('dots', 'balls', 100)} AS dot_pct, {rate('boundaries', 'balls', 100)} AS boundary_pct FROM ow JOIN op USING (player, format)")(
    lambda t: rec.official_bowling(read_rich(t)).select(*OW_COLUMNS, "economy", "average", "strike_rate", "dot_pct", "boundary_pct")
)


def official_by_id(t):
    """Careers by resolved ids: P1 and P2 of a team are one player, P3 of every team shares its name with another, P4 has an alias only."""
    t = t.stored()
    names = staged(t.deliveries.select("batter", "bowler").distinct().select(F.explode(F.array("batter", "bowler")).alias("name")).distinct(), "names")
    last = F.regexp_extract("name", "P([0-9]+)$", 1)
    players = names.where(~last.isin("2", "4")).select(F.concat(F.lit("id-"), "name").alias("id"), F.upper("name").alias("name"), F.when(last == "1", F.regexp_replace("name", "P1$", "P2")).alias("full_name"))
    players = players.unionByName(names.where(last == "3").select(F.concat(F.lit("other-"), "name").alias("id"), "name", F.lit(None).cast("string").alias("full_name")))
    known = staged(resolver(players, names.where(last == "4").select(F.lower("name").alias("alias"), F.concat(F.lit("via-"), "name").alias("id"))), "known")
    lines = rec.official_lines(read_rich(t), known)
    return rec.bowling_careers(lines).select("player", "format", "innings", "wickets", "balls", "matches")


ID_OF = "CASE regexp_extract(bowler, 'P([0-9]+)$', 1) WHEN '2' THEN 'id-' || replace(bowler, 'P2', 'P1') WHEN '4' THEN 'via-' || bowler WHEN '3' THEN NULL ELSE 'id-' || bowler END"
query("official_by_id", f", ov AS ({OW_OVERS}), ln AS ({OW_LINES}) SELECT {ID_OF} AS player, format, count(*) AS innings, CAST(sum(wickets) AS BIGINT) AS wickets, CAST(sum(balls) AS BIGINT) AS balls, count(DISTINCT match_id) AS matches FROM ln WHERE {ID_OF} IS NOT NULL GROUP BY ALL")(official_by_id)
OM = f"om AS (SELECT batter, bowler, format, count_if(faced) AS balls, {total('runs_batter')} AS runs, count_if(credited AND dismissed_player = batter) AS wickets, count_if(faced AND runs_total = 0) AS dots, count_if(four OR six) AS boundaries, count_if(six) AS sixes FROM flags WHERE {WITH_INNINGS} GROUP BY batter, bowler, format HAVING count_if(faced) >= 10)"
query("official_matchups", f", {OM} SELECT *, {rate('runs', 'balls', 100)} AS strike_rate, {rate('runs', 'wickets')} AS average FROM om")(lambda t: rec.official_matchups(m.flatten(read_rich(t))))


def official_write(t):
    """Official matchups in place of the stored ones of their formats; formats that aren't rebuilt keep their rows."""
    path, new = fresh_path(t.spark, "official"), rec.official_matchups(m.flatten(read_rich(t))).select("batter", "bowler", "format", "balls", "wickets")
    old = t.deliveries.select("batter", "bowler", "format", F.lit(0).cast("long").alias("balls"), F.lit(0).cast("long").alias("wickets")).distinct()
    sinks.swapped_formats(old, new, ["T20", "T20I", "ODI"]).write.partitionBy("format").parquet(path)
    return t.spark.read.schema(new.schema).parquet(path).select("batter", "bowler", "format", "balls", "wickets")


query("official_write", f", {OM} SELECT batter, bowler, format, balls, wickets FROM om WHERE format <> 'Test' UNION ALL SELECT DISTINCT batter, bowler, format, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM flags WHERE format = 'Test'")(official_write)

# readers and preparation
query("scan_match_json", f"SELECT match_id, format, {WITH_INNINGS} AS with_innings FROM matches")(lambda t: m.read_matches(t.spark, one_a_file(t)).select("match_id", F.col("info.match_type").alias("format"), F.col("innings").isNotNull().alias("with_innings")))


def one_a_file(t):
    """A document a file, called as its match, in folders by the first three digits: names and paths sort alike."""
    path = fresh_path(t.spark, "files")
    docs = read_rich(t)
    name = F.concat(F.lit("folder="), F.substring("match_id", 1, 4), F.lit("/"), "match_id", F.lit(".json"))
    sinks.write_files(docs.select(name.alias("name"), F.to_json(F.struct(*docs.columns)).alias("content")), path)
    return path


def by_folder(t):
    """read_matches over files named after the match."""
    path = one_a_file(t)
    return path, m.read_matches(t.spark, path)


query("scan_file_batch", f"SELECT match_id, format FROM matches WHERE match_id IN ('m1', 'm2', 'm3')")(
    lambda t: (lambda path: m.read_matches(t.spark, *[f"{path}/folder={k}/{k}.json" for k in ("m1", "m2", "m3")]).select("match_id", F.col("info.match_type").alias("format")))(one_a_file(t))
)
query("fn_match_id", "SELECT match_id, match_id AS from_path FROM matches")(lambda t: by_folder(t)[1].select("match_id", F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("from_path")))
query("scan_directory_limited", "SELECT match_id FROM matches ORDER BY match_id LIMIT 20")(lambda t: (lambda docs: m.first_files(docs, 20).select("match_id"))(by_folder(t)[1]))
query("prepare_matches", f"SELECT match_id, format AS original_match_type, CASE WHEN format = 'T20' AND {MN} % 3 = 0 THEN 'T20I' ELSE format END AS prepared_format FROM matches WHERE {MN} % 5 <> 0")(
    lambda t: m.prepared(read_rich(t), gender="male").select("match_id", "meta.original_match_type", "meta.prepared_format")
)
query("prepare_validate", f"SELECT 'missing_innings' AS problem, count_if(NOT ({WITH_INNINGS})) AS n FROM matches UNION ALL SELECT 'missing_match_id', CAST(0 AS BIGINT) UNION ALL SELECT 'innings_without_team', CAST(0 AS BIGINT) UNION ALL SELECT 'innings_without_overs', CAST(0 AS BIGINT) UNION ALL SELECT 'valid', count_if({WITH_INNINGS}) FROM matches")(
    lambda t: m.problems(read_rich(t))
)
query("prepare_profile", f"SELECT format, gender, team_type, count(*) AS matches, min(match_date) AS first_date, max(match_date) AS last_date FROM (SELECT *, CASE WHEN {MN} % 5 = 0 THEN 'female' ELSE 'male' END AS gender, CASE WHEN {MN} % 3 = 0 THEN 'international' ELSE 'club' END AS team_type FROM matches) GROUP BY format, gender, team_type")(
    lambda t: m.profile(read_rich(t))
)
query("scan_registries", f"SELECT 'T' || regexp_extract(team, '([0-9]+)$', 1) || 'P' || p AS name, team, 'id-T' || regexp_extract(team, '([0-9]+)$', 1) || 'P' || p AS ids FROM (SELECT DISTINCT unnest([team_a, team_b]) AS team FROM matches), range(11) AS x(p)")(
    lambda t: m.registries(read_rich(t)).select("name", "team", F.array_join("ids", ",").alias("ids"))
)
query("proj_result_type", f"SELECT match_id, CASE WHEN {MN} % 7 > 2 THEN 'win' WHEN {MN} % 7 = 0 THEN 'tie' ELSE 'no_result' END AS result_type FROM matches")(lambda t: read_rich(t).select("match_id", m.result_type().alias("result_type")))
query("fn_json_path", f"SELECT match_id, CASE WHEN {MN} % 5 = 0 THEN 'female' ELSE 'male' END AS gender, CASE WHEN {MN} % 7 > 2 THEN team_a END AS winner FROM matches")(lambda t: read_rich(t).select("match_id", "info.gender", F.col("info.outcome.winner").alias("winner")))
query("fn_element_at", "SELECT match_id, match_date, team_b FROM matches")(lambda t: read_rich(t).select("match_id", F.get("info.dates", 0).try_cast("date").alias("match_date"), F.get("info.teams", 1).alias("team_b")))
query("fn_extra_type", f"SELECT extra_type, count(*) AS n FROM flags WHERE {WITH_INNINGS} GROUP BY extra_type")(lambda t: m.flatten(read_rich(t)).groupBy("extra_type").agg(F.count("*").alias("n")))
query("flatten_batch_variant", f"SELECT match_id, count(*) AS balls, count(DISTINCT bowling_team) AS sides FROM flags WHERE {WITH_INNINGS} GROUP BY match_id")(lambda t: m.flatten(read_rich(t)).groupBy("match_id").agg(F.count("*").alias("balls"), F.countDistinct("bowling_team").alias("sides")))


def zipped(t):
    """Documents in ZIP archives of some two hundred each, members dealt to tasks by 64 KB."""
    path, zips = rich(t), fresh_path(t.spark, "zips")
    written = m.write_zips(t.spark.read.text(path).select("value"), zips, 200)
    written.write.parquet(f"{zips}-list")  # writes the archives
    return m.read_zip(t.spark, zips, task_bytes=1 << 16)


query("scan_zip_scorecards", f"SELECT match_id, format FROM matches WHERE {MN} % 5 <> 0")(lambda t: zipped(t).where("info.gender = 'male'").select("match_id", F.col("info.match_type").alias("format")))


def prepare_counts(t):
    """(count, n) of a preparation in which every thirteenth document is cut off."""
    n = F.regexp_extract("value", '"match_id":"m([0-9]+)"', 1).cast("int")
    lines = t.spark.read.text(rich(t)).select(F.concat(F.lit("m"), n.cast("string"), F.lit(".json")).alias("file"), F.when(n % 13 == 4, F.substring("value", 1, 200)).otherwise(F.col("value")).alias("value"))
    path = fresh_path(t.spark, "prepared")
    counts = m.write_prepared(lines, path)
    counts["read_again"] = t.spark.read.json(path).where("meta.prepared_format is not null").count()
    return t.spark.createDataFrame(sorted(counts.items()), "count string, n long")


CUT, MALE, REMAPPED = f"{MN} % 13 = 4", f"{MN} % 5 <> 0", f"format = 'T20' AND {MN} % 3 = 0"
query("prepare_counts", " UNION ALL ".join(f"SELECT '{k}' AS count, count_if({c}) AS n FROM matches" for k, c in {"total": "true", "malformed": CUT, "filtered_out": f"NOT ({CUT}) AND NOT ({MALE})", "format_remapped": f"NOT ({CUT}) AND {MALE} AND {REMAPPED}", "written": f"NOT ({CUT}) AND {MALE}", "read_again": f"NOT ({CUT}) AND {MALE}"}.items()))(prepare_counts)


def two_roots(t):
    """Documents of two roots, of which the second holds every tenth match again."""
    roots, docs = [fresh_path(t.spark, "root") for _ in range(2)], read_rich(t)
    for root, some in zip(roots, (docs, docs.where(F.substring("match_id", 2, 9).cast("int") % 10 == 1))):
        some.write.json(root, compression="gzip")
    return m.several_sources(m.read_lines(t.spark, *roots)).select("match_id", "n", F.size("files").cast("long").alias("files"))


query("duplicate_documents", f"SELECT match_id, CAST(2 AS BIGINT) AS n, CAST(2 AS BIGINT) AS files FROM matches WHERE {MN} % 10 = 1")(two_roots)


def register(t):
    """A register in two CSV files, people and their other names."""
    path = fresh_path(t.spark, "register")
    people = t.deliveries.select(F.col("batter").alias("name")).distinct()
    people.select(F.concat(F.lit("id-"), "name").alias("identifier"), "name").write.option("header", True).csv(f"{path}/people")
    people.where("name like '%P3'").select(F.concat(F.lit("id-"), "name").alias("identifier"), F.concat(F.lit("Mr "), "name").alias("name")).write.option("header", True).csv(f"{path}/names")
    return merges.read_register(t.spark, f"{path}/people", f"{path}/names")


query("scan_register_csv", "SELECT DISTINCT 'id-' || batter AS id, batter AS name FROM deliveries UNION ALL SELECT DISTINCT 'id-' || batter, 'Mr ' || batter FROM deliveries WHERE batter LIKE '%P3'")(register)
query("validate_batch_variant", "SELECT match_id, count(*) AS n FROM flags WHERE over_number <= 100 AND ball_in_over BETWEEN 1 AND 9 GROUP BY match_id")(lambda t: i.validate(t.deliveries, strict=True).groupBy("match_id").agg(F.count("*").alias("n")))

# cards, their checks and repairs. Every match whose number ends in 7 has a card with doubled runs
BADCARD = f"{CARD_SQL}, bc AS (SELECT * REPLACE (CASE WHEN match_id LIKE '%7' THEN runs * 9 ELSE runs END AS runs) FROM full_card), bw AS (SELECT match_id, innings_number, sum(charged) AS conceded FROM flags GROUP BY match_id, innings_number)"


def bad_card(t):
    return i.scorecard_batting(t.deliveries).withColumn("runs", F.when(F.col("match_id").like("%7"), F.col("runs") * 9).otherwise(F.col("runs")))


CARD_P = "SELECT match_id, innings_number, 'strike rate above 400' AS problem, count_if(balls > 0 AND runs * 100 > balls * 400) AS n FROM bc GROUP BY match_id, innings_number HAVING n > 0 UNION ALL SELECT match_id, innings_number, 'bowling below batting', CAST(1 AS BIGINT) FROM (SELECT match_id, innings_number, sum(runs) AS made FROM bc GROUP BY match_id, innings_number) JOIN bw USING (match_id, innings_number) WHERE conceded < made"
query("validate_scorecard", f", {BADCARD} {CARD_P}")(lambda t: rec.card_problems(bad_card(t), i.scorecard_bowling(t.deliveries)))
query("verify_scorecards", f", {BADCARD} SELECT count(DISTINCT match_id) AS matches, count(*) AS rows, count_if(player IS NULL) AS without_player, count_if(runs < 0 OR balls < 0) AS negative, count_if(balls > 0 AND runs * 100 > balls * 400) AS too_fast, (SELECT count(*) FROM matches) AS of_matches FROM bc WHERE match_id NOT LIKE '%8'")(
    lambda t: y.card_coverage(bad_card(t).where("match_id NOT LIKE '%8'"), t.matches)
)
query("detect_inflation", f", {CARD_SQL}, x AS (SELECT match_id, innings_number, CAST(sum(runs * CASE WHEN match_id LIKE '%7' THEN 9 ELSE 1 END) AS BIGINT) AS card_runs, CAST(sum(runs) AS BIGINT) AS rebuilt FROM full_card GROUP BY ALL), y AS (SELECT match_id, innings_number, CAST(sum(runs_total) AS BIGINT) AS runs FROM deliveries GROUP BY ALL) SELECT match_id, innings_number, card_runs, runs, rebuilt FROM x JOIN y USING (match_id, innings_number) WHERE card_runs > runs * 1.5")(
    lambda t: (lambda found: found.join(i.scorecard_batting(t.deliveries.join(found.select("match_id").distinct(), "match_id", "left_semi")).groupBy("match_id", "innings_number").agg(r.total("runs").alias("rebuilt")), ["match_id", "innings_number"]).select("match_id", "innings_number", "card_runs", "runs", "rebuilt"))(
        q.card_against_innings(bad_card(t), i.innings_totals(t.deliveries))
    )
)


def rebuilt(t):
    """Cards of the affected matches made anew, the others as stored."""
    stored = bad_card(t).select("match_id", "innings_number", "player", "runs")
    wrong = rec.card_problems(bad_card(t), i.scorecard_bowling(t.deliveries)).select("match_id").distinct()
    return sinks.replaced_matches(stored, i.scorecard_batting(t.deliveries.join(wrong, "match_id", "left_semi")).select("match_id", "innings_number", "player", "runs"))


query("rebuild_scorecards", f", {BADCARD} SELECT match_id, innings_number, player, CASE WHEN match_id IN (SELECT match_id FROM ({CARD_P})) THEN full_card.runs ELSE bc.runs END AS runs FROM full_card JOIN bc USING (match_id, innings_number, player)")(rebuilt)
query("scorecard_from_rows", "SELECT match_id, innings_number, batter AS player, CAST(sum(runs_batter) AS BIGINT) AS runs, count(*) AS balls FROM deliveries GROUP BY match_id, innings_number, batter")(lambda t: y.card_of_rows(t.deliveries))
def replaced_directory(t):
    """(status, matches): a directory's matches as they are new, changed or the same in the stored totals, which they replace."""
    new = m.flatten(read_rich(t)).groupBy("match_id").agg(r.total("runs_total").alias("runs"))
    old = t.deliveries.where("season <> '2022'").groupBy("match_id").agg((r.total("runs_total") + F.when(F.substring("match_id", 2, 9).cast("int") % 4 == 0, 1).otherwise(0)).alias("old"))
    both = new.join(old, "match_id", "left")
    return both.groupBy(F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("runs"), "changed").otherwise("same").alias("status")).agg(F.count("*").alias("matches"))


query("replace_directory_scorecards", f"SELECT CASE WHEN season = '2022' THEN 'new' WHEN {MN} % 4 = 0 THEN 'changed' ELSE 'same' END AS status, count(*) AS matches FROM matches WHERE {WITH_INNINGS} GROUP BY ALL")(replaced_directory)

# audits: defects by fixed rules, so that each check has something to find
query("audit_players", "SELECT 'players' AS category, 'duplicate_name' AS \"check\", CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n FROM (SELECT count(*) AS n FROM (SELECT s_suppkey % 50 AS k, s_suppkey % 9 = 0 AS marked FROM supplier GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'players', 'bracketed_name', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, n FROM (SELECT count_if(s_suppkey % 9 = 0) AS n FROM supplier) UNION ALL SELECT 'players', 'orphan_alias', CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, n FROM (SELECT count_if(s_suppkey % 7 = 0) AS n FROM supplier) UNION ALL SELECT 'players', 'total', 'PASS', count(*) FROM supplier")(
    lambda t: q.audit_dimension(
        t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("P "), (F.col("s_suppkey") % 50).cast("string"), F.when(F.col("s_suppkey") % 9 == 0, " (x)").otherwise("")).alias("name")), "players",
        aliases=t.raw("supplier").select(F.when(F.col("s_suppkey") % 7 == 0, F.col("s_suppkey") + 10**6).otherwise(F.col("s_suppkey")).alias("id")),
    )
)
for _name, _status in (("audit_teams", "FAIL"), ("audit_venues", "WARN")):
    _cat, _col = _name.removeprefix("audit_"), "batting_team" if _status == "FAIL" else "venue"
    query(_name, f"SELECT '{_cat}' AS category, 'duplicate_name' AS \"check\", CASE WHEN n > 0 THEN '{_status}' ELSE 'PASS' END AS status, n FROM (SELECT count_if({_col} LIKE '%1' OR {_col} LIKE '%3') AS n FROM (SELECT DISTINCT {_col} FROM deliveries)) UNION ALL SELECT '{_cat}', 'total', 'PASS', count(DISTINCT {_col}) + count(DISTINCT {_col}) FILTER ({_col} LIKE '%1' OR {_col} LIKE '%3') FROM deliveries")(
        lambda t, c=_col, k=_cat, s=_status: (lambda d: q.audit_dimension(d.select(F.sha1("name").alias("id"), "name").unionByName(d.where("name like '%1' or name like '%3'").select(F.sha1(F.concat("name", F.lit("2"))).alias("id"), F.upper("name").alias("name"))), k, status=s, brackets=False))(t.deliveries.select(F.col(c).alias("name")).distinct())
    )
AGG = f", {BAT_SQL}, {BOWL_SQL}, cb AS ({career_bat_sql('player, format')}), cw AS ({career_bowl_sql('bowler, format')}) "


def audit_analytics(t):
    known = t.deliveries.select(F.col("batter").alias("player")).where("batter not like '%P1'").distinct()
    from wicketflow.operators import careers as c

    tables = {"batting": c.career_batting(t.bat_lines), "bowling": c.career_bowling(t.bowl_lines).withColumnRenamed("bowler", "player")}
    return reduce(lambda a, b: a.unionByName(b), [part for k, df in tables.items() for part in (q.counted(df, k, {"null_id": F.col("player").isNull()}), q.orphans(df, "player", known, "player", k, "orphan_player"), q.size(df, k))])


def analytics_sql(name, table, column):
    return f"SELECT '{name}' AS category, 'null_id' AS \"check\", CASE WHEN count_if({column} IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count_if({column} IS NULL) AS n FROM {table} UNION ALL SELECT '{name}', 'orphan_player', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM {table} WHERE {column} NOT IN (SELECT batter FROM deliveries WHERE batter NOT LIKE '%P1') UNION ALL SELECT '{name}', 'total', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM {table}"


query("audit_analytics", AGG + analytics_sql("batting", "cb", "player") + " UNION ALL " + analytics_sql("bowling", "cw", "bowler"))(audit_analytics)
query("audit_scorecards", f", {CARD_SQL} SELECT 'scorecards' AS category, 'null_player' AS \"check\", 'PASS' AS status, count_if(player IS NULL) AS n FROM full_card UNION ALL SELECT 'scorecards', 'match_without_card', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM matches WHERE match_id LIKE '%8' UNION ALL SELECT 'scorecards', 'total', 'PASS', count(*) FROM full_card WHERE match_id NOT LIKE '%8'")(
    lambda t: (lambda card: q.counted(card, "scorecards", {"null_player": F.col("player").isNull()}).unionByName(q.orphans(t.matches, "match_id", card, "match_id", "scorecards", "match_without_card")).unionByName(q.size(card, "scorecards")))(i.scorecard_batting(t.deliveries.where("match_id not like '%8'")))
)

"""Registered queries over names looked up by their runs, chains of merges, and tables compared with their copies.

Names are those of suppliers; copies get their defects by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.operators import digests, grams
from wicketflow.operators import identity as x
from wicketflow.operators import innings as i
from wicketflow.operators import keys
from wicketflow.operators import names as n
from wicketflow.operators import quality as q
from wicketflow.plans.innings_queries import BAT_SQL
from wicketflow.plans.player_queries import bat
from wicketflow.registry import query
from wicketflow.sources.shared import fresh_path, shuffles_removed, staged

MN = "CAST(substr(match_id, 2) AS INT)"


def number():
    """A match's number, from its id."""
    return F.substring("match_id", 2, 9).cast("int")


# names: parts of suppliers' names, of several lengths and from several places, most of which several names hold
PARTS = ", part AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN substr(s_name, 10 + s_suppkey % 5, 4 + s_suppkey % 6) WHEN 1 THEN upper(substr(s_name, 3 + s_suppkey % 9, 9)) ELSE substr(s_name, 9) || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'x' END END AS name FROM supplier) "


def parts(t):
    k, name = F.col("s_suppkey"), F.col("s_name")
    tail = F.concat(F.substring(name, 9, 99), F.when(k % 2 == 0, "").otherwise("x"))
    return t.raw("supplier").select(F.when(k % 3 == 0, F.substring(name, 10 + k % 5, 4 + k % 6)).when(k % 3 == 1, F.upper(F.substring(name, 3 + k % 9, F.lit(9)))).otherwise(tail).alias("name")).distinct()


def suppliers(t):
    return t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("short"))


query("match_name_parts", PARTS + "SELECT name, (SELECT CASE WHEN count(*) = 1 THEN min(s_suppkey) END FROM supplier WHERE contains(lower(s_name), lower(name)) AND length(name) >= 3) AS id FROM part")(
    lambda t: n.resolve_unambiguous(parts(t), suppliers(t))
)
query("name_part_holders", PARTS + "SELECT lower(name) AS part, CAST(count(s_suppkey) AS BIGINT) AS n, CAST(sum(s_suppkey) AS BIGINT) AS ids FROM (SELECT DISTINCT lower(name) AS name FROM part WHERE length(name) >= 3) JOIN supplier ON contains(lower(s_name), name) GROUP BY 1")(
    lambda t: grams.holders(parts(t).select(F.lower("name").alias("part")).distinct(), suppliers(t).select("id", F.lower("name").alias("text")), "part", "text").groupBy("part").agg(F.count("id").alias("n"), r.total("id").alias("ids"))
)
RUNS = """, run AS (SELECT s_suppkey AS id, unnest(list_transform(range(1, length(s_name) - 1), lambda i: lower(substr(s_name, i, 3)))) AS run FROM supplier), f AS (SELECT run, count(*) AS n FROM run GROUP BY run),
own AS (SELECT DISTINCT part, unnest(list_transform(range(1, length(part) - 1), lambda i: {'at': i - 1, 'run': substr(part, i, 3)})) AS x FROM (SELECT DISTINCT lower(name) AS part FROM part WHERE length(name) >= 3)) """
query("rarest_runs", PARTS + RUNS + "SELECT part, run, CAST(n AS BIGINT) AS n FROM (SELECT part, x.run AS run, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY part ORDER BY coalesce(n, 0), x.run, x.at) AS k FROM own LEFT JOIN f ON f.run = own.x.run) WHERE k = 1 AND n > 0")(
    lambda t: grams.rarest(parts(t).select(F.lower("name").alias("part")), grams.runs(suppliers(t).select(F.lower("name").alias("text")), "text"), "part").select("part", "run", "n")
)
query("match_team_parts", PARTS + "SELECT name, CASE WHEN name IN (SELECT 'c' || s_suppkey FROM supplier) THEN NULL ELSE (SELECT CASE WHEN count(*) = 1 THEN min(s_suppkey) END FROM supplier WHERE contains(lower(s_name), lower(name)) AND length(name) >= 3) END AS id FROM part UNION ALL SELECT 'twice', NULL UNION ALL SELECT 'once', min(s_suppkey) FROM supplier")(
    # a short name of two suppliers is in doubt; that of one isn't
    lambda t: x.team_matches(parts(t).unionByName(t.spark.range(2).select(F.when(F.col("id") == 0, "twice").otherwise("once").alias("name"))), (lambda s: s.withColumn("short", F.when(F.col("id") == s.agg(F.min("id")).first()[0], "once").otherwise("twice")))(suppliers(t)))
)


# merges: each id into the one before it, in chains of up to eleven; every third chain is a cycle, some ids have two targets
def merges(t):
    k = F.col("s_suppkey")
    step = t.raw("supplier").where(k % 11 != 0).select(k.alias("from_id"), (k - 1).alias("to_id"))
    back = t.raw("supplier").where((k % 11 == 0) & (F.floor(k / 11) % 3 == 1)).select(k.alias("from_id"), (k + 10).alias("to_id"))
    fork = t.raw("supplier").where((k % 11 == 5) & (F.floor(k / 11) % 3 == 2)).select(k.alias("from_id"), (k + 10**6).alias("to_id"))
    return step.unionByName(back).unionByName(fork).unionByName(t.raw("supplier").select(k.alias("from_id"), k.alias("to_id")))


MERGES = """, link AS (SELECT s_suppkey AS a, s_suppkey - 1 AS b FROM supplier WHERE s_suppkey % 11 <> 0 UNION SELECT s_suppkey, s_suppkey + 10 FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey // 11 % 3 = 1
  UNION SELECT s_suppkey, s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 11 = 5 AND s_suppkey // 11 % 3 = 2),
one AS (SELECT a, min(b) AS b FROM link GROUP BY a HAVING count(*) = 1),
walked AS (WITH RECURSIVE walk AS (SELECT a, b, 1 AS hops FROM one UNION ALL SELECT walk.a, one.b, hops + 1 FROM walk JOIN one ON walk.b = one.a WHERE hops < 40) SELECT * FROM walk),
ended AS (SELECT a, max(hops) AS hops, max_by(b, hops) AS b FROM walked GROUP BY a) """
ENDS = "SELECT a AS from_id, CASE WHEN hops < 40 THEN b END AS to_id, CASE WHEN hops < 40 THEN CAST(hops AS BIGINT) END AS hops, CASE WHEN hops >= 40 THEN 'cycle' END AS refused FROM ended UNION ALL SELECT a, NULL, NULL, 'fork' FROM link GROUP BY a HAVING count(*) > 1"
query("merge_chains", MERGES + ENDS)(lambda t: n.chain_ends(merges(t)))


def merged_everywhere(t):
    """Parts and order lines re-pointed to the suppliers that stay, the merged ones gone: rows left of each table, and their sums."""
    ends = n.chain_ends(merges(t)).where("refused is null").select("from_id", "to_id")
    lines = t.raw("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    left, tables = n.merge_everywhere(t.raw("supplier").select(F.col("s_suppkey").alias("id")), {"lines": (lines, ["l_suppkey"], []), "pairs": (lines.select("l_suppkey", "l_partkey"), ["l_suppkey"], ["l_suppkey", "l_partkey"])}, ends)
    rows = left.select(F.lit("suppliers").alias("table"), F.col("id").alias("key"), F.lit(1).cast("long").alias("n"))
    return rows.unionByName(tables["lines"].groupBy("l_suppkey").agg(r.total("n").alias("n")).select(F.lit("lines").alias("table"), F.col("l_suppkey").alias("key"), "n")).unionByName(
        tables["pairs"].groupBy("l_suppkey").agg(F.count("*").alias("n")).select(F.lit("pairs").alias("table"), F.col("l_suppkey").alias("key"), "n")
    )


query("merge_everywhere", MERGES + """, en AS (SELECT a, b FROM ended WHERE hops < 40), moved AS (SELECT coalesce(b, l_suppkey) AS key, l_partkey FROM lineitem LEFT JOIN en ON a = l_suppkey)
SELECT 'suppliers' AS "table", s_suppkey AS key, CAST(1 AS BIGINT) AS n FROM supplier WHERE s_suppkey NOT IN (SELECT a FROM en) UNION ALL SELECT 'lines', key, count(*) FROM moved GROUP BY key UNION ALL SELECT 'pairs', key, count(DISTINCT l_partkey) FROM moved GROUP BY key""")(merged_everywhere)  # fmt: skip


# copies: one cell of every 97th match's first over changed, some rows lost, some there twice, some added; counts of matches equal
BALL = list(i.EVENT)
HIT, LOST, TWICE = f"{MN} % 97 = 5 AND over_number = 0", f"{MN} % 89 = 7 AND over_number = 1", f"{MN} % 83 = 3 AND over_number = 2"


def stores(t):
    """(source, target): matches and deliveries, and copies of them that were written elsewhere and then changed."""
    t, path, m = t.stored(), fresh_path(t.spark, "copy"), number()
    d, o = t.deliveries.drop("m"), F.col("over_number")
    hit = (m % 97 == 5) & (o == 0)
    there = d.where(~((m % 89 == 7) & (o == 1))).withColumns({"runs_total": F.when(hit, F.col("runs_total") + 1).otherwise(F.col("runs_total")), "venue": F.when(hit & (F.col("ball_in_over") == 1), None).otherwise(F.col("venue"))})
    there = there.unionByName(there.where((m % 83 == 3) & (o == 2)))
    matches = t.matches.withColumn("winner", F.when(m % 41 == 2, F.lit("nobody")).otherwise(F.col("winner")))
    for name, df, dealt in (("matches", matches, ["venue", "match_id"]), ("deliveries", there.select(*sorted(there.columns)), ["over_number", "match_id"])):
        with shuffles_removed(t.spark):
            df.repartition(*dealt).write.parquet(f"{path}/{name}")  # by other columns than source's, to as many tasks as the session has
    return {"matches": t.matches, "deliveries": d}, {k: t.spark.read.parquet(f"{path}/{k}") for k in ("matches", "deliveries")}


KEYS = {"matches": ["match_id"], "deliveries": BALL}
KEYED = f", keyed AS (SELECT {', '.join(BALL)}, count(*) AS n, bool_or({HIT}) AS hit, bool_or({LOST}) AS lost, bool_or({TWICE}) AS twice FROM deliveries GROUP BY {', '.join(BALL)}) "
UNLIKE = "(SELECT count(*) FROM keyed WHERE hit OR lost OR twice)"
query("copy_tables_verified", KEYED + f"SELECT 'matches' AS \"table\", count(*) AS source, count(*) AS target, CAST(0 AS BIGINT) AS orphans, count_if({MN} % 41 = 2 AND winner IS DISTINCT FROM 'nobody') AS differing FROM matches UNION ALL SELECT 'deliveries', count(*), count(*) - count_if({LOST}) + count_if({TWICE}), CAST(0 AS BIGINT), {UNLIKE} FROM deliveries")(
    lambda t: (lambda s: q.compared(*s, {"deliveries": ("match_id", "matches")}, KEYS))(stores(t))
)
query("copy_differences", KEYED + f"SELECT {', '.join(BALL)}, CASE WHEN lost THEN 'missing' WHEN n > 1 OR twice THEN 'repeated' ELSE 'changed' END AS kind, CASE WHEN hit AND n = 1 THEN CASE WHEN ball_in_over = 1 THEN 'runs_total,venue' ELSE 'runs_total' END ELSE '' END AS columns FROM keyed WHERE hit OR lost OR twice")(
    lambda t: (lambda s: digests.differences(s[0]["deliveries"], s[1]["deliveries"], BALL).withColumn("columns", F.array_join(F.array_sort("columns"), ",")))(stores(t))
)


def synced(t):
    """Checks of a target that lost matches, whose deliveries' venues are empty here and there, and that has its leaders right but one."""
    t = t.stored()
    d, m = t.deliveries.drop("m"), number()
    target = {"matches": t.matches.where(m % 9 != 0), "deliveries": d.withColumn("venue", F.when(m % 10 != 4, F.col("venue")))}
    totals = staged(d.groupBy("match_id").agg(r.total("runs_total").alias("runs")), "totals")
    golden = t.matches.where(m % 50 == 1).select("match_id", F.when(m == 1, F.lit("elsewhere")).otherwise(F.col("venue")).alias("venue"))
    source = {"matches": t.matches, "deliveries": d, "totals": totals}
    return q.sync_checks(source, target | {"totals": totals.withColumn("runs", F.col("runs").cast("int"))}, KEYS | {"totals": ["match_id"]}, links={"deliveries": ["venue", "dismissed_player"]}, references={"deliveries": ("match_id", "matches")}, covered={"deliveries": ("match_id", "matches")}, golden={"matches": golden})


def _check(category, check, want, have, source):
    return f"SELECT '{category}' AS category, '{check}' AS \"check\", CAST({want} AS BIGINT) AS expected, CAST({have} AS BIGINT) AS actual, CASE WHEN ({want}) = ({have}) THEN 'PASS' ELSE 'FAIL' END AS status FROM {source}"


DISTINCT_BALLS = f"count(DISTINCT ({', '.join(BALL)}))"
query("verify_sync", " UNION ALL ".join([
    _check("matches", "rows", "count(*)", f"count_if({MN} % 9 <> 0)", "matches"), _check("matches", "differing", "0", f"count_if({MN} % 9 = 0)", "matches"),
    _check("matches", "golden rows", f"count_if({MN} % 50 = 1)", f"count_if({MN} % 50 = 1 AND {MN} <> 1 AND {MN} % 9 <> 0)", "matches"),
    _check("deliveries", "rows", "count(*)", "count(*)", "deliveries"), _check("deliveries", "differing", "0", DISTINCT_BALLS, f"deliveries WHERE {MN} % 10 = 4"),
    _check("deliveries", "filled venue", "count(*)", f"count_if({MN} % 10 <> 4)", "deliveries"), _check("deliveries", "filled dismissed_player", "count(dismissed_player)", "count(dismissed_player)", "deliveries"),
    _check("deliveries", "orphans of matches", "0", f"count_if({MN} % 9 = 0)", "deliveries"), _check("deliveries", "covers matches", f"count_if({MN} % 9 <> 0)", f"count_if({MN} % 9 <> 0)", "matches"),
    _check("totals", "rows", "count(*)", "count(*)", "matches"), _check("totals", "differing", "0", "0", "(SELECT 1)"),
]))(synced)


def twice(t):
    """Two runs of the same job, each written by itself in another partitioning, and the keys that aren't the same in both.

    The runs deal their input by columns, to as many tasks as the session has for a shuffle, so a task's part doesn't grow with it.
    """
    t, paths = t.stored(), []
    for dealt in (["match_id", "over_number"], ["bowler", "batter", "match_id"]):
        paths.append(fresh_path(t.spark, "run"))
        i.scorecard_batting(i.dedupe_events(t.deliveries.repartition(*dealt))).write.parquet(paths[-1])
    a, b = (t.spark.read.parquet(p) for p in paths)
    differ = digests.differences(a, b, ["match_id", "innings_number", "player"]).agg(F.count("*").alias("differing"))
    return differ.crossJoin(F.broadcast(a.agg(F.count("*").alias("rows"), r.total("runs").alias("runs"))))  # one row each


query("verify_idempotency", "SELECT CAST(0 AS BIGINT) AS differing, count(*) AS rows, (SELECT CAST(sum(runs_batter) AS BIGINT) FROM deliveries) AS runs FROM (SELECT DISTINCT match_id, innings_number, p FROM (SELECT match_id, innings_number, unnest([batter, non_striker]) AS p FROM deliveries) WHERE p IS NOT NULL)")(twice)


# tables that refer to one another: competitions, matches, innings, lines; venues beside them, which a match can be without
REFERENCES = [keys.Reference("lines", "innings_id", "innings"), keys.Reference("innings", "match_id", "matches"), keys.Reference("matches", "competition_id", "competitions"), keys.Reference("matches", "venue_id", "venues", required=False)]


def graph(t):
    t = t.stored()
    d, inn = t.deliveries, F.concat_ws("-", "match_id", F.col("innings_number").cast("string"))
    lines = staged(d.groupBy("match_id", "innings_number", "batter").agg(F.count("*").alias("balls")), "lines")
    return {
        "lines": lines.select(inn.alias("innings_id"), "batter", "balls"),
        "innings": lines.select(inn.alias("id"), "match_id").distinct(),
        "matches": t.matches.select(F.col("match_id").alias("id"), F.col("competition").alias("competition_id"), F.col("venue").alias("venue_id")),
        "competitions": t.matches.select(F.col("competition").alias("id")).distinct(),
        "venues": t.matches.select(F.col("venue").alias("id")).distinct(),
    }


def summed(tables, rejected):
    """(table, reason, n): rows kept, under no reason, and rejected ones under theirs."""
    kept = keys.total({k: v.withColumn("reason", F.lit("kept")) for k, v in tables.items()}, "reason")
    return kept.unionByName(keys.total(rejected, "reason"))


def remapped_graph(t):
    """One call brings five tables to new ids: competition 2, venue V3 and every thirteenth match have none."""
    tables = graph(t)
    new = lambda k, where: tables[k].where(where).select(F.col("id").alias("old_id"), F.concat(F.lit("x:"), "id").alias("new_id"))
    ids = {"competitions": new("competitions", "id <> 'Cup 2'"), "venues": new("venues", "id <> 'V3'"), "matches": new("matches", "CAST(substr(id, 2) AS INT) % 13 <> 6")}
    out, rejected = keys.remapped(tables, REFERENCES, ids)
    emptied = out["matches"].where("venue_id IS NULL").agg(F.count("*").alias("n")).select(F.lit("matches").alias("table"), F.lit("without venue").alias("reason"), "n")
    renamed = out["matches"].where("id LIKE 'x:m%' AND competition_id LIKE 'x:Cup%'").agg(F.count("*").alias("n")).select(F.lit("matches").alias("table"), F.lit("renamed").alias("reason"), "n")
    moved = out["innings"].where("match_id LIKE 'x:m%'").agg(F.count("*").alias("n")).select(F.lit("innings").alias("table"), F.lit("renamed").alias("reason"), "n")
    return summed(out, rejected).unionByName(emptied).unionByName(renamed).unionByName(moved)


LINES = ", line AS (SELECT match_id, innings_number, batter FROM deliveries GROUP BY ALL), inn AS (SELECT DISTINCT match_id, innings_number FROM deliveries), mm AS (SELECT match_id, competition, venue, CAST(substr(match_id, 2) AS INT) AS k FROM matches) "
GOOD = "k % 13 <> 6 AND competition <> 'Cup 2'"
query("remap_references", LINES + f"""SELECT 'competitions' AS "table", CASE WHEN competition = 'Cup 2' THEN 'no id' ELSE 'kept' END AS reason, count(DISTINCT competition) AS n FROM mm GROUP BY 2
UNION ALL SELECT 'venues', CASE WHEN venue = 'V3' THEN 'no id' ELSE 'kept' END, count(DISTINCT venue) FROM mm GROUP BY 2
UNION ALL SELECT 'matches', CASE WHEN k % 13 = 6 THEN 'no id' WHEN competition = 'Cup 2' THEN 'no competitions: competition_id' ELSE 'kept' END, count(*) FROM mm GROUP BY 2
UNION ALL SELECT 'innings', CASE WHEN {GOOD} THEN 'kept' ELSE 'no matches: match_id' END, count(*) FROM inn JOIN mm USING (match_id) GROUP BY 2
UNION ALL SELECT 'lines', CASE WHEN {GOOD} THEN 'kept' ELSE 'no innings: innings_id' END, count(*) FROM line JOIN mm USING (match_id) GROUP BY 2
UNION ALL SELECT 'matches', 'without venue', count(*) FROM mm WHERE {GOOD} AND venue = 'V3' UNION ALL SELECT 'matches', 'renamed', count(*) FROM mm WHERE {GOOD} UNION ALL SELECT 'innings', 'renamed', count(*) FROM inn JOIN mm USING (match_id) WHERE {GOOD}""")(remapped_graph)  # fmt: skip


def purged_graph(t):
    """One call takes out a competition, a venue and some innings with all that hangs on them: rows left, and rows gone at each level."""
    tables = graph(t)
    gone = {"competitions": tables["competitions"].where("id = 'Cup 1'"), "venues": tables["venues"].where("id = 'V2'"), "innings": tables["innings"].where("id LIKE '%5-2'")}
    left, lost = keys.purged(tables, REFERENCES, gone)
    kept = keys.total({k: v.withColumn("level", F.lit(-1)) for k, v in left.items()}, "level")
    empty = left["matches"].where("venue_id IS NULL").agg(F.count("*").alias("n")).select(F.lit("matches").alias("table"), F.lit(-2).alias("level"), "n")
    return kept.unionByName(keys.total(lost, "level")).unionByName(empty)


LEVEL = "CASE WHEN inn.match_id LIKE '%5' AND inn.innings_number = 2 THEN 0 WHEN competition = 'Cup 1' THEN 2 ELSE -1 END"
query("purge_references", LINES + f"""SELECT 'competitions' AS "table", CAST(CASE WHEN competition = 'Cup 1' THEN 0 ELSE -1 END AS INT) AS level, count(DISTINCT competition) AS n FROM mm GROUP BY 2
UNION ALL SELECT 'venues', CASE WHEN venue = 'V2' THEN 0 ELSE -1 END, count(DISTINCT venue) FROM mm GROUP BY 2 UNION ALL SELECT 'matches', CASE WHEN competition = 'Cup 1' THEN 1 ELSE -1 END, count(*) FROM mm GROUP BY 2
UNION ALL SELECT 'matches', -2, count(*) FROM mm WHERE competition <> 'Cup 1' AND venue = 'V2' UNION ALL SELECT 'innings', {LEVEL}, count(*) FROM inn JOIN mm USING (match_id) GROUP BY 2
UNION ALL SELECT 'lines', CASE WHEN {LEVEL} < 0 THEN -1 ELSE {LEVEL} + 1 END, count(*) FROM line AS inn JOIN mm USING (match_id) GROUP BY 2""")(purged_graph)  # fmt: skip


def upserted(t):
    """New matches with ids for their names: teams are required, venue and winner aren't; the season of 2022 is stored already."""
    d, m = t.matches, number()
    team = d.select(F.explode(F.array("team_a", "team_b")).alias("name")).distinct().where("name <> 'Team5'").select("name", F.concat(F.lit("t:"), "name").alias("id"))
    venue = d.select(F.col("venue").alias("name")).distinct().where("name <> 'V6'").select("name", F.concat(F.lit("v:"), "name").alias("id"))
    won, first = F.col("winner").isNotNull(), F.col("winner") == F.col("team_a")
    rows = d.where("season <> '2022'").withColumn("win_type", keys.win_type(F.when(won & (m % 16 == 3), 1), F.when(won & first, F.col("first_runs") - F.col("second_runs")), F.when(won & (~first | (m % 5 == 0)), 10 - F.col("second_wickets"))))
    good, bad = keys.with_ids(rows, {"team_a": (team, True), "team_b": (team, True), "venue": (venue, False), "winner": (team, False)})
    columns = ["match_id", "team_a_id", "team_b_id", "venue_id", "winner_id", "win_type"]
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).select(*columns, "reason")


query("upsert_match_keys", f"""SELECT match_id, CASE WHEN team_a <> 'Team5' THEN 't:' || team_a END AS team_a_id, CASE WHEN team_b <> 'Team5' THEN 't:' || team_b END AS team_b_id, CASE WHEN venue <> 'V6' THEN 'v:' || venue END AS venue_id, CASE WHEN winner <> 'Team5' THEN 't:' || winner END AS winner_id,
CASE WHEN winner IS NULL THEN NULL WHEN {MN} % 16 = 3 THEN 'innings' WHEN winner = team_a AND first_runs <> second_runs THEN 'runs' WHEN (winner <> team_a OR {MN} % 5 = 0) AND second_wickets <> 10 THEN 'wickets' END AS win_type, CASE WHEN team_a = 'Team5' THEN 'team_a' WHEN team_b = 'Team5' THEN 'team_b' END AS reason FROM matches WHERE season <> '2022'""")(upserted)  # fmt: skip

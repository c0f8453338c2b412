"""Registered queries over scores and ratings of players, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wicketflow.operators import careers as c
from wicketflow.operators import scores as s
from wicketflow.plans.innings_queries import BAT_SQL, BOWL_SQL
from wicketflow.plans.player_queries import bat, bowl, career_bat_sql, career_bowl_sql
from wicketflow.registry import query
from wicketflow.sources.shared import fresh_path

BL = f", {BAT_SQL} "


def milli(*names):
    """Scores to 1e-6 as integers: sums of doubles differ in the last bits between engines."""
    return [F.floor(F.col(n) * 1e6 + 0.5).cast("long").alias(n) for n in names]


def milli_sql(*names):
    return ", ".join(f"CAST(floor({n} * 1e6 + 0.5) AS BIGINT) AS {n}" for n in names)


query("recent_n_innings", BL + "SELECT * FROM (SELECT player, format, match_id, runs, CAST(row_number() OVER (PARTITION BY player, format ORDER BY match_date DESC, match_id DESC, innings_number DESC) AS INT) AS n FROM bl) WHERE n <= 10")(
    lambda t: s.recent_innings(bat(t)).select("player", "format", "match_id", "runs", "n")
)
CB = f", {BAT_SQL}, cb AS ({career_bat_sql('player, format')}), {BOWL_SQL}, cw AS ({career_bowl_sql('bowler, format')}) "


def mm(col: str, invert: bool = False) -> str:
    top, low = f"max({col}) OVER (PARTITION BY format)", f"min({col}) OVER (PARTITION BY format)"
    part = f"{top} - {col}" if invert else f"{col} - {low}"
    return f"coalesce(({part}) / nullif({top} - {low}, 0) * 100, 50.0)"


for _name, _col in (("minmax_by_format", "average"), ("join_minmax", "strike_rate")):
    query(_name, CB + f"SELECT player, format, {mm(_col)} AS score FROM cb")(lambda t, k=_col: s.scaled(c.career_batting(bat(t)), ["format"], {k: False}).select("player", "format", F.col(f"{k}_component").alias("score")))


def pr(col: str, order: str = "ASC", keys: str = "format", alone: bool = True) -> str:
    n = f"count(*) OVER (PARTITION BY {keys}, {col} IS NOT NULL)"
    score = f"(rank() OVER (PARTITION BY {keys}, {col} IS NOT NULL ORDER BY {col} {order}) + (count(*) OVER (PARTITION BY {keys}, {col}) - 1) / 2.0::DOUBLE) / {n} * 100"
    if alone:
        score = f"CASE WHEN {n} = 1 THEN 50.0 ELSE {score} END"
    return f"CASE WHEN {col} IS NOT NULL THEN {score} END"


query("percent_rank_avg", CB + f"SELECT player, format, {pr('average')} AS score, {pr('average', 'DESC')} AS inverted FROM cb")(
    lambda t: s.percentiles(c.career_batting(bat(t)), ["player", "format"], ["format"], {"up": (F.col("average"), False), "down": (F.col("average"), True)}).select("player", "format", F.col("up_rank").alias("score"), F.col("down_rank").alias("inverted"))
)
def season_percentiles(t):
    t = t.stored()
    runs = bat(t).join(t.matches.select("match_id", "season"), "match_id").groupBy("player", "season").agg(F.sum("runs").alias("runs"))
    return s.percentiles(runs, ["player", "season"], ["season"], {"runs": (F.col("runs"), False)}, alone=None).select("player", "season", F.col("runs_rank").alias("score"))


query("percent_rank_season", f", {BAT_SQL}, x AS (SELECT player, season, CAST(sum(runs) AS BIGINT) AS runs FROM bl JOIN matches USING (match_id) GROUP BY ALL) SELECT player, season, {pr('runs', keys='season', alone=False)} AS score FROM x")(season_percentiles)
FI = """, fi0 AS (SELECT *, row_number() OVER (PARTITION BY player, format ORDER BY match_date DESC, match_id DESC, innings_number DESC) AS n FROM bl),
fb AS (SELECT player, format, count(*) AS innings, sum(runs)::DOUBLE AS runs, sum(balls)::DOUBLE AS balls, sum(runs)::DOUBLE / count(*) AS mean, stddev_samp(runs) AS deviation, avg(runs) FILTER (n <= 10) AS recent_mean, avg(runs) FILTER (innings_number = 2) AS chase_mean FROM fi0 GROUP BY player, format),
fv AS (SELECT player, format, stddev_samp(m) AS vd, avg(m) AS vm FROM (SELECT player, format, venue, avg(runs) AS m FROM bl GROUP BY ALL) GROUP BY player, format),
fo AS (SELECT player, format, sum(m * b) / nullif(sum(b), 0) AS opp FROM (SELECT player, format, bowling_team, avg(runs) AS m, sum(balls)::DOUBLE AS b FROM bl GROUP BY ALL) GROUP BY player, format),
fi AS (SELECT player, format, innings, CASE WHEN innings >= 5 THEN recent_mean END AS recent, CASE WHEN innings >= 5 AND mean > 0 THEN deviation / mean END AS consistency, opp AS opposition, CASE WHEN vm > 0 THEN vd / vm END AS venue,
 CASE WHEN mean > 0 THEN chase_mean / mean END AS situation, CASE WHEN balls > 0 THEN runs * 100 / balls * mean / 100 END AS efficiency FROM fb LEFT JOIN fv USING (player, format) LEFT JOIN fo USING (player, format)),
fc AS (SELECT player, format, """ + ", ".join(f"{mm(k, k in ('consistency', 'venue'))} AS {k}_component" for k in s.FORM) + """ FROM fi),
fs AS (SELECT *, """ + " + ".join(f"{k}_component * {w}::DOUBLE" for k, w in s.FORM.items()) + " AS form_score FROM fc) "
for _k in s.FORM:
    query(f"form_{_k}", BL + FI + f"SELECT player, format, {milli_sql(f'{_k}_component')} FROM fc")(lambda t, k=_k: s.form_score(s.form_inputs(t.bat_lines)).select("player", "format", *milli(f"{k}_component")))
_form = (*[f"{k}_component" for k in s.FORM], "form_score")
query("form_score", BL + FI + f"SELECT player, format, {milli_sql(*_form)} FROM fs")(lambda t: s.form_score(s.form_inputs(t.bat_lines)).select("player", "format", *milli(*_form)))
query("join_components", BL + FI + f"SELECT player, format, {milli_sql('form_score')} FROM fs")(lambda t: s.form_score(s.form_inputs(t.bat_lines)).select("player", "format", *milli("form_score")))

# impact: what surrounds a player's batting, careers, the last 548 days
CX = """, oa AS (SELECT bowling_team, format, sum(balls)::DOUBLE AS b, sum(conceded)::DOUBLE AS c, sum(wickets)::DOUBLE AS w FROM wl GROUP BY ALL),
ob AS (SELECT bowling_team, format, CAST(b AS BIGINT) AS balls, CASE WHEN b > 0 THEN c * 6 / b END AS economy, coalesce(CASE WHEN b > 0 THEN w * 6 / b END, 0) AS wicket_rate FROM oa),
os AS (SELECT *, (""" + mm("economy", True) + " + " + mm("wicket_rate") + """) / 2 AS strength FROM ob),
fl AS (SELECT bl.*, coalesce(strength, 50) AS strength, row_number() OVER (PARTITION BY player, format ORDER BY match_date DESC, match_id DESC, innings_number DESC) AS n FROM bl LEFT JOIN os USING (bowling_team, format) WHERE bl.balls > 0),
cv AS (SELECT player, format, count(*) AS venues, avg(m) AS vm, stddev_samp(m) AS vd FROM (SELECT player, format, venue, avg(runs) AS m FROM fl GROUP BY ALL) GROUP BY ALL),
ca AS (SELECT player, format, count(*) AS innings, count(*) FILTER (n <= 10) AS recent_innings, max(match_date) AS last_match_date, avg(runs) FILTER (n <= 10) AS recent, avg(runs) AS mean, stddev_samp(runs) AS sd, sum(strength * balls) / sum(balls) AS opposition,
 avg(runs) FILTER (innings_number = 2) AS chase, count(*) FILTER (innings_number = 2) AS chases, sum(runs)::DOUBLE * 100 / sum(balls) AS sr FROM fl GROUP BY ALL),
ci AS (SELECT player, format, innings, recent_innings, last_match_date, recent, CASE WHEN mean > 0 THEN greatest(0, (1 - sd / mean) * 100) ELSE 0 END AS consistency, opposition,
 CASE WHEN venues > 1 AND vm > 0 THEN greatest(0, (1 - vd / vm) * 100) ELSE 50 END AS venue, CASE WHEN format <> 'Test' AND chases >= 2 AND mean > 0 THEN chase / mean ELSE 1 END AS situation, sr * mean / 100 AS efficiency
 FROM ca JOIN cv USING (player, format) WHERE innings >= 3),
cx AS (SELECT *, """ + ", ".join(f"{mm(k)} AS {k}_component" for k in s.CONTEXT) + " FROM ci) "
_context = [f"{k}_component" for k in s.CONTEXT]
query("opposition_strength", CB + CX + f"SELECT bowling_team, format, balls, {milli_sql('economy', 'wicket_rate', 'strength')} FROM os")(lambda t: s.opposition_strength(bowl(t)).select("bowling_team", "format", "balls", *milli("economy", "wicket_rate", "strength")))
query("impact_context", CB + CX + f"SELECT player, format, innings, recent_innings, last_match_date, {milli_sql(*_context)} FROM cx")(
    lambda t: s.impact_context(t.bat_lines, t.bowl_lines).select("player", "format", "innings", "recent_innings", "last_match_date", *milli(*_context))
)
query("recent_n_head", CB + CX + f"SELECT player, format, {milli_sql('recent')} FROM ci")(lambda t: s.impact_context(t.bat_lines, t.bowl_lines).select("player", "format", *milli("recent")))


def valid(column, condition, order="ASC"):
    """The percentile of column among a format's rows that meet condition."""
    return pr(f"(CASE WHEN {condition} THEN {column} END)", order)


BATS, BOWLS, RBATS, RBOWLS = "bi >= 3", "wi >= 3 AND wb > 0", "rbi >= 2", "rwi >= 2 AND rwb > 0"
BOTH = "coalesce(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 0.75 * greatest({a}, {b}) + 0.25 * least({a}, {b}) END, {a}, {b}, 50)"
REC = """, u AS (SELECT player, format, match_id, match_date, 1 AS bat, runs, balls, 0 AS bowl, 0 AS wickets, 0 AS bowled, 0 AS conceded FROM bl UNION ALL SELECT bowler, format, match_id, match_date, 0, 0, 0, 1, wickets, balls, conceded FROM wl),
rc AS (SELECT player, format, count(DISTINCT match_id) AS rm, sum(bat)::DOUBLE AS rbi, sum(bowl)::DOUBLE AS rwi, sum(bowled)::DOUBLE AS rwb, sum(runs)::DOUBLE / nullif(sum(bat), 0) AS rb, sum(runs)::DOUBLE * 100 / nullif(sum(balls), 0) AS rs,
 sum(wickets)::DOUBLE / nullif(sum(bowl), 0) AS rw, sum(conceded)::DOUBLE * 6 / nullif(sum(bowled), 0) AS re FROM u WHERE match_date >= (SELECT max(match_date) - 548 FROM u) GROUP BY player, format),
iw AS (SELECT coalesce(cb.player, cw.bowler) AS player, coalesce(cb.format, cw.format) AS format, cb.innings AS bi, ln(1 + cb.runs) AS bv, coalesce(cb.average, cb.runs::DOUBLE) AS ba, coalesce(cb.strike_rate, 0) AS bs,
 cw.innings AS wi, cw.balls AS wb, cw.wickets / cw.innings::DOUBLE AS wr, ln(1 + cw.wickets) AS wv, cw.economy AS we FROM cb FULL JOIN cw ON cb.player = cw.bowler AND cb.format = cw.format),
ix AS (SELECT * FROM iw FULL JOIN rc USING (player, format)),
iy AS (SELECT ix.*, cx.* EXCLUDE (player, format, innings, recent_innings, last_match_date, recent, consistency, opposition, venue, situation, efficiency) FROM ix LEFT JOIN cx USING (player, format)),
ir AS (SELECT *, """ + ", ".join(f"{valid(x, k, o)} AS {x}_rank" for x, k, o in (("ba", BATS, "ASC"), ("bs", BATS, "ASC"), ("bv", BATS, "ASC"), ("wr", BOWLS, "ASC"), ("we", BOWLS, "DESC"), ("wv", BOWLS, "ASC"), ("rb", RBATS, "ASC"), ("rs", RBATS, "ASC"), ("rw", RBOWLS, "ASC"), ("re", RBOWLS, "DESC"))) + """ FROM iy),
ib AS (SELECT *, 50 + (0.45::DOUBLE * ba_rank + 0.25::DOUBLE * bs_rank + 0.30::DOUBLE * bv_rank - 50) * bi / (bi + 8.0::DOUBLE) AS b, 50 + (0.45::DOUBLE * wr_rank + 0.25::DOUBLE * we_rank + 0.30::DOUBLE * wv_rank - 50) * wi / (wi + 8.0::DOUBLE) AS w,
 0.65::DOUBLE * rb_rank + 0.35::DOUBLE * rs_rank AS fb, 0.65::DOUBLE * rw_rank + 0.35::DOUBLE * re_rank AS fw, coalesce(bi, 0) + coalesce(wi, 0) AS innings FROM ir),
ic AS (SELECT player, format, innings, """ + BOTH.format(a="b", b="w") + " AS performance, CASE WHEN rm > 0 THEN 50 + (" + BOTH.format(a="fb", b="fw") + """ - 50) * rm / (rm + 5.0::DOUBLE) ELSE coalesce(recent_component, 50) END AS recent,
 coalesce(situation_component, 50) AS pressure, coalesce(opposition_component, 50) AS opposition, coalesce(consistency_component, 50) AS consistency, coalesce(efficiency_component, 50) AS efficiency FROM ib),
im AS (SELECT *, """ + " + ".join(f"{k} * {w}::DOUBLE" for k, w in s.IMPACT.items()) + " AS impact FROM ic) "


def impact(t):
    t = t.stored()
    lines, overs = t.bat_lines, t.bowl_lines
    return s.impact_score(c.career_batting(lines), c.career_bowling(overs), c.recent_stats(lines, overs), s.impact_context(lines, overs))


IM = CB + CX + REC
query("impact_score", IM + f"SELECT player, format, {milli_sql(*s.IMPACT, 'impact')} FROM im")(lambda t: impact(t).select("player", "format", *milli(*s.IMPACT, "impact")))
query("impact_pipeline", IM + f"SELECT format, count(*) AS players, {milli_sql('mean')} FROM (SELECT format, count(*) AS n, avg(impact) AS mean FROM im GROUP BY format) JOIN im USING (format) GROUP BY format, mean")(
    lambda t: impact(t).groupBy("format").agg(F.count("*").alias("players"), F.avg("impact").alias("mean")).select("format", "players", *milli("mean"))
)
query("impact_rollup", IM + f"SELECT player, {milli_sql('impact')} FROM (SELECT player, sum(impact * innings) / sum(innings) AS impact FROM im WHERE innings > 0 GROUP BY player)")(
    lambda t: impact(t).groupBy("player").agg(c.weighted_mean("impact", "innings").alias("impact")).where("impact is not null").select("player", *milli("impact"))
)
query("dash_top_players", IM + f"SELECT player, format, {milli_sql('impact')} FROM (SELECT * FROM im ORDER BY floor(impact * 1e6 + 0.5) DESC, player, format LIMIT 10)")(
    lambda t: impact(t).select("player", "format", *milli("impact")).orderBy(F.desc("impact"), "player", "format").limit(10)
)


def recompute(t):
    """A stored table that also holds players who are gone, replaced whole by what the current careers give."""
    path = fresh_path(t.spark, "impact")
    old = t.bat_lines.select(F.concat(F.lit("old "), "player").alias("player"), "format").distinct().withColumn("impact", F.lit(50.0))
    old.write.parquet(path)
    impact(t).select("player", "format", "impact").write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path).select("player", "format", *milli("impact"))


query("impact_recompute", IM + f"SELECT player, format, {milli_sql('impact')} FROM im")(recompute)
query("impact_career_rows", f", {BAT_SQL}, halves AS ({career_bat_sql('player, format, innings_number')}) SELECT player, format, CAST(sum(innings) AS BIGINT) AS innings, CAST(sum(runs) AS BIGINT) AS runs, {milli_sql('average', 'strike_rate')} FROM (SELECT player, format, sum(innings) AS innings, sum(runs) AS runs, avg(average) AS average, avg(strike_rate) AS strike_rate FROM halves GROUP BY player, format) GROUP BY player, format, average, strike_rate")(
    lambda t: s.career_rows(c.career_batting(bat(t), ("player", "format", "innings_number")), ["innings", "runs"], ["average", "strike_rate"]).select("player", "format", "innings", "runs", *milli("average", "strike_rate"))
)
query("fn_shrinkage", CB + f"SELECT player, format, {milli_sql('x')} FROM (SELECT player, format, 50 + (strike_rate - 50) * innings / (innings + 8.0::DOUBLE) AS x FROM cb)")(
    lambda t: c.career_batting(bat(t)).select("player", "format", s.shrink(F.col("strike_rate"), F.col("innings"), 8).alias("x")).select("player", "format", *milli("x"))
)
query("fn_role_combine", CB + f"SELECT player, format, {milli_sql('x')} FROM (SELECT player, format, {BOTH.format(a='average', b='strike_rate')} AS x FROM cb)")(
    lambda t: c.career_batting(bat(t)).select("player", "format", s.combine_roles(F.col("average"), F.col("strike_rate")).alias("x")).select("player", "format", *milli("x"))
)
# season impact: the same ranks within one edition, one value alone at 100
ED = ["competition", "season"]


def edition(column, condition, order="ASC"):
    return pr(f"(CASE WHEN {condition} THEN {column} END)", order, "competition, season", alone=False)


SI = f""", {BAT_SQL}, {BOWL_SQL}, sb AS ({career_bat_sql('player, competition, season', '(SELECT bl.*, competition, season FROM bl JOIN matches USING (match_id))')}), sw AS ({career_bowl_sql('bowler, competition, season', '(SELECT wl.*, competition, season FROM wl JOIN matches USING (match_id))')}),
sx AS (SELECT coalesce(sb.player, sw.bowler) AS player, coalesce(sb.competition, sw.competition) AS competition, coalesce(sb.season, sw.season) AS season, sb.innings AS bi, ln(1 + sb.runs) AS bv, sb.average AS ba, sb.strike_rate AS bs, sw.innings AS wi, sw.balls AS wb,
 sw.wickets / sw.innings::DOUBLE AS wr, ln(1 + sw.wickets) AS wv, sw.economy AS we FROM sb FULL JOIN sw ON sb.player = sw.bowler AND sb.competition = sw.competition AND sb.season = sw.season),
sr AS (SELECT *, """ + ", ".join(f"{edition(x, k, o)} AS {x}_rank" for x, k, o in (("ba", BATS, "ASC"), ("bs", BATS, "ASC"), ("bv", BATS, "ASC"), ("wr", BOWLS, "ASC"), ("we", BOWLS, "DESC"), ("wv", BOWLS, "ASC"))) + """ FROM sx),
ss AS (SELECT *, 50 + (0.45::DOUBLE * ba_rank + 0.25::DOUBLE * bs_rank + 0.30::DOUBLE * bv_rank - 50) * bi / (bi + 8.0::DOUBLE) AS b, 50 + (0.45::DOUBLE * wr_rank + 0.25::DOUBLE * we_rank + 0.30::DOUBLE * wv_rank - 50) * wi / (wi + 8.0::DOUBLE) AS w FROM sr) """


def in_editions(t, lines):
    return lines.join(t.matches.select("match_id", *ED), "match_id")


def edition_impact(t):
    t = t.stored()
    return s.season_impact(c.career_batting(in_editions(t, t.bat_lines), ("player", *ED)), c.career_bowling(in_editions(t, t.bowl_lines), ("bowler", *ED)), ED)


query("season_impact", SI + f"SELECT player, competition, season, {milli_sql('x')} FROM (SELECT player, competition, season, CASE WHEN b IS NOT NULL OR w IS NOT NULL THEN {BOTH.format(a='b', b='w')} END AS x FROM ss)")(
    lambda t: edition_impact(t).withColumnRenamed("impact", "x").select("player", *ED, *milli("x"))
)
query("season_players", SI + f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY competition, season ORDER BY x DESC NULLS LAST, player) AS INT) AS n FROM (SELECT player, competition, season, {milli_sql('x')} FROM (SELECT player, competition, season, CASE WHEN b IS NOT NULL OR w IS NOT NULL THEN {BOTH.format(a='b', b='w')} END AS x FROM ss))) WHERE n BETWEEN 11 AND 20")(
    lambda t: edition_impact(t).withColumnRenamed("impact", "x").select("player", *ED, *milli("x")).withColumn("n", F.row_number().over(c.Window.partitionBy(*ED).orderBy(F.desc_nulls_last("x"), "player"))).where("n between 11 and 20")
)
# ratings, with the impact of the player in the format; to 1e-6, so that both engines rank alike
RO = ", ro AS (SELECT coalesce(cb.player, cw.bowler) AS player, coalesce(cb.format, cw.format) AS format, CASE WHEN coalesce(cw.balls, 0) >= 30 AND coalesce(cb.innings, 0) >= 5 THEN 'allrounder' WHEN coalesce(cw.balls, 0) >= 30 THEN 'bowler' ELSE 'batter' END AS role FROM cb FULL JOIN cw ON cb.player = cw.bowler AND cb.format = cw.format) "
RK = "SELECT * FROM (SELECT format, CAST(row_number() OVER (PARTITION BY format ORDER BY rating DESC, player) AS INT) AS rank, player, rating FROM (SELECT player, format, CAST(floor(({rating}) * 1e6 + 0.5) AS BIGINT) AS rating FROM {rows})) WHERE rank <= 20"


def rated(t, roles, rating, least, both=False):
    t = t.stored()
    lines, overs = t.bat_lines, t.bowl_lines
    bats, bowls = c.career_batting(lines), c.career_bowling(overs).withColumnRenamed("bowler", "player")
    rows = bats.join(bowls.select("player", "format", "wickets"), ["player", "format"], "full") if both else bowls if "bowler" in roles else bats
    own = s.roles(bats, c.career_bowling(overs)).where(F.col("role").isin(*roles)).select("player", "format")
    rows = rows.join(own, ["player", "format"], "left_semi").join(impact(t).select("player", "format", "impact"), ["player", "format"], "left")
    return s.ranked(rows, F.floor(rating * 1e6 + 0.5).cast("long"), 20, least)


query("rank_batting", IM + RO + RK.format(rating="0.4::DOUBLE * coalesce(average, 0) + 0.3::DOUBLE * coalesce(strike_rate, 0) + 0.3::DOUBLE * coalesce(impact, 50)", rows="cb JOIN ro USING (player, format) LEFT JOIN im USING (player, format) WHERE role IN ('batter', 'allrounder') AND cb.innings >= 5"))(
    lambda t: rated(t, ("batter", "allrounder"), s.batting_rating(), 5)
)
query("rank_bowling", IM + RO + RK.format(rating="0.3::DOUBLE * wickets + 2.5::DOUBLE * (10 - least(coalesce(economy, 15), 10)) + 0.15::DOUBLE * (30 - least(coalesce(average, 60), 30)) + 0.3::DOUBLE * coalesce(impact, 50)", rows="(SELECT bowler AS player, * EXCLUDE (bowler) FROM cw) cw JOIN ro USING (player, format) LEFT JOIN im USING (player, format) WHERE role IN ('bowler', 'allrounder') AND cw.innings >= 5"))(
    lambda t: rated(t, ("bowler", "allrounder"), s.bowling_rating(), 5)
)
query("rank_allrounder", IM + RO + RK.format(rating="0.25::DOUBLE * coalesce(average, 0) + 0.15::DOUBLE * coalesce(strike_rate, 0) + 0.3::DOUBLE * coalesce(wickets, 0) + 0.3::DOUBLE * coalesce(impact, 50)", rows="(SELECT cb.player, cb.format, cb.average, cb.strike_rate, cw.wickets FROM cb JOIN cw ON cb.player = cw.bowler AND cb.format = cw.format) JOIN ro USING (player, format) LEFT JOIN im USING (player, format) WHERE role = 'allrounder'"))(
    lambda t: rated(t, ("allrounder",), s.allround_rating(), 0, both=True)
)
query("rank_number", CB + "SELECT player, format, CAST(row_number() OVER (PARTITION BY format ORDER BY runs DESC, player) AS INT) AS n FROM cb")(
    lambda t: s.numbered(c.career_batting(bat(t)).select("player", "format", "runs"), ["format"], [-F.col("runs"), F.col("player")]).select("player", "format", "n")
)
query("season_top_batters", f", {BAT_SQL}, x AS (SELECT player, competition, season, CAST(sum(runs) AS BIGINT) AS runs FROM bl JOIN matches USING (match_id) GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY competition, season ORDER BY runs DESC, player) AS INT) AS n FROM x) WHERE n <= 10")(
    lambda t: bat(t).join(t.matches.select("match_id", "competition", "season"), "match_id").groupBy("player", "competition", "season").agg(F.sum("runs").alias("runs")).withColumn("n", F.row_number().over(c.Window.partitionBy("competition", "season").orderBy(F.desc("runs"), "player"))).where("n <= 10")
)
query("season_top_bowlers", f", {BOWL_SQL}, x AS (SELECT bowler, competition, season, CAST(sum(wickets) AS BIGINT) AS wickets FROM wl JOIN matches USING (match_id) GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY competition, season ORDER BY wickets DESC, bowler) AS INT) AS n FROM x) WHERE n <= 10")(
    lambda t: bowl(t).join(t.matches.select("match_id", "competition", "season"), "match_id").groupBy("bowler", "competition", "season").agg(F.sum("wickets").alias("wickets")).withColumn("n", F.row_number().over(c.Window.partitionBy("competition", "season").orderBy(F.desc("wickets"), "bowler"))).where("n <= 10")
)
query("top_venue_players", f", {BAT_SQL} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY venue ORDER BY runs DESC, player) AS INT) AS n FROM (SELECT venue, player, CAST(sum(runs) AS BIGINT) AS runs FROM bl GROUP BY ALL)) WHERE n <= 10")(
    lambda t: bat(t).groupBy("venue", "player").agg(F.sum("runs").alias("runs")).withColumn("n", F.row_number().over(c.Window.partitionBy("venue").orderBy(F.desc("runs"), "player"))).where("n <= 10")
)
query("list_players", CB + "SELECT player, format, runs, average FROM cb ORDER BY average DESC NULLS LAST, player, format LIMIT 30 OFFSET 10")(lambda t: c.career_batting(bat(t)).select("player", "format", "runs", "average").orderBy(F.desc_nulls_last("average"), "player", "format").offset(10).limit(30))
query("player_history", f", {BAT_SQL} SELECT * FROM (SELECT player, match_id, match_date, runs, CAST(row_number() OVER (PARTITION BY player ORDER BY match_date DESC, match_id, innings_number) AS INT) AS n FROM bl) WHERE n <= 10")(
    lambda t: bat(t).select("player", "match_id", "match_date", "runs", F.row_number().over(c.Window.partitionBy("player").orderBy(F.desc("match_date"), "match_id", "innings_number")).alias("n")).where("n <= 10")
)
query("scope_rollup_batting", CB + "SELECT player, CAST(sum(innings) AS BIGINT) AS innings, CAST(sum(runs) AS BIGINT) AS runs, CAST(least(greatest(sum(not_outs), 0), sum(innings)) AS BIGINT) AS not_outs, max(highest) AS highest FROM cb WHERE format IN ('T20I', 'ODI', 'Test') GROUP BY player")(
    lambda t: c.career_batting(bat(t)).where("format in ('T20I', 'ODI', 'Test')").groupBy("player").agg(F.sum("innings").alias("innings"), F.sum("runs").alias("runs"), F.least(F.greatest(F.sum("not_outs"), F.lit(0)), F.sum("innings")).alias("not_outs"), F.max("highest").alias("highest"))
)
query("scope_rollup_bowling", CB + "SELECT bowler, CAST(sum(balls) AS BIGINT) AS balls, CAST(sum(conceded) AS BIGINT) AS conceded, CAST(sum(wickets) AS BIGINT) AS wickets FROM cw WHERE format IN ('T20I', 'ODI', 'Test') GROUP BY bowler")(
    lambda t: c.career_bowling(bowl(t)).where("format in ('T20I', 'ODI', 'Test')").groupBy("bowler").agg(F.sum("balls").alias("balls"), F.sum("conceded").alias("conceded"), F.sum("wickets").alias("wickets"))
)

"""Lines of an innings: batting and bowling per player, phases, running scores, totals, scorecards.

Input: deliveries (one row a ball). Every operator is one conditional aggregation or window; nothing is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.functions import rules as r

INNINGS = ["match_id", "innings_number"]
EVENT = [*INNINGS, "over_number", "ball_in_over"]


def validate(d: DataFrame, *, strict: bool = False) -> DataFrame:
    """Rows with batter and bowler, no negative runs or overs, overs up to 100 except in multi-day formats.

    strict: the same bound for every format, and balls 1 to 9 only.
    """
    ok = F.col("batter").isNotNull() & F.col("bowler").isNotNull() & (F.col("runs_total") >= 0) & (F.col("over_number") >= 0)
    if strict:
        return d.where(ok & (F.col("over_number") <= 100) & F.col("ball_in_over").between(1, 9))
    return d.where(ok & ((F.col("over_number") <= 100) | F.col("format").isin(*r.MULTI_DAY)))


def rejected(d: DataFrame) -> DataFrame:
    """The rows that validate() drops, with the first rule that each breaks."""
    why = (
        F.when(F.col("batter").isNull(), "no batter")
        .when(F.col("bowler").isNull(), "no bowler")
        .when(F.coalesce(F.col("runs_total"), F.lit(-1)) < 0, "negative runs")
        .when(F.coalesce(F.col("over_number"), F.lit(-1)) < 0, "negative over")
        .when((F.col("over_number") > 100) & ~F.col("format").isin(*r.MULTI_DAY), "over beyond 100")
    )
    return d.withColumn("reason", why).where("reason is not null")


def dedupe_events(d: DataFrame) -> DataFrame:
    """One row for each event key; which one is decided by a total order, so reruns agree."""
    rest = [F.col(c) for c in d.columns if c not in EVENT]
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(*EVENT).orderBy(*rest))).where("_n = 1").drop("_n")


def cumulative(d: DataFrame) -> DataFrame:
    """Running runs and wickets within each innings."""
    w = Window.partitionBy(*INNINGS).orderBy("over_number", "ball_in_over").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("cum_runs", F.sum("runs_total").over(w).cast("long")).withColumn("cum_wickets", F.sum(F.col("is_wicket").cast("int")).over(w).cast("long"))


def match_context(d: DataFrame) -> DataFrame:
    """First-innings total, and the target of the second, on every ball; a window sum, no join."""
    first = F.sum(F.when(F.col("innings_number") == 1, F.col("runs_total")).otherwise(0)).over(Window.partitionBy("match_id")).cast("long")
    return d.withColumn("first_innings_total", first).withColumn("target", F.when(F.col("innings_number") == 2, first + 1))


def phase_stats(d: DataFrame) -> DataFrame:
    return d.groupBy(*INNINGS, r.phase().alias("phase")).agg(
        r.total("runs_total").alias("runs"),
        r.count_if(r.legal_ball()).alias("balls"),
        r.count_if(F.col("is_wicket")).alias("wickets"),
        r.count_if(r.boundary(4) | r.boundary(6)).alias("boundaries"),
        r.count_if(r.legal_ball() & (F.col("runs_total") == 0)).alias("dots"),
    )


def batting_lines(d: DataFrame) -> DataFrame:
    """A line per player and innings, with dismissals of the non-striker on the non-striker's line.

    Each ball gives the striker's row and, on a dismissal, a row of the player who is out: one shuffle instead of a join.
    """
    who = ["format", "match_id", "match_date", "venue", "innings_number", "batting_team", "bowling_team"]
    faces = d.select(
        *who, F.col("batter").alias("player"), "runs_batter", "runs_total", r.ball_faced().alias("faced"), r.boundary(4).alias("four"), r.boundary(6).alias("six"), F.lit(False).alias("gone"), F.lit(1).alias("strikes")
    )
    out = d.where(r.batter_out()).select(
        *who, F.coalesce("dismissed_player", "batter").alias("player"), F.lit(0).alias("runs_batter"), F.lit(0).alias("runs_total"), F.lit(False).alias("faced"), F.lit(False).alias("four"), F.lit(False).alias("six"), F.lit(True).alias("gone"), F.lit(0).alias("strikes")
    )
    return faces.unionByName(out).groupBy(*who, "player").agg(
        r.total("runs_batter").alias("runs"),
        r.count_if(F.col("faced")).alias("balls"),
        r.count_if(F.col("four")).alias("fours"),
        r.count_if(F.col("six")).alias("sixes"),
        r.count_if(F.col("faced") & (F.col("runs_total") == 0)).alias("dots"),
        F.max("gone").alias("out"),
    )


def bowling_lines(d: DataFrame) -> DataFrame:
    who = ["format", "match_id", "match_date", "venue", "innings_number", "bowling_team", "batting_team", "bowler"]
    return d.groupBy(*who).agg(
        r.count_if(r.legal_ball()).alias("balls"),
        r.total(r.bowler_runs()).alias("conceded"),
        r.count_if(r.bowler_wicket()).alias("wickets"),
        r.count_if(r.legal_ball() & (F.col("runs_total") == 0)).alias("dots"),
        r.count_if(r.boundary(4) | r.boundary(6)).alias("boundaries"),
        r.total("extras_wides").alias("wides"),
        r.total("extras_noballs").alias("noballs"),
    )


def innings_totals(d: DataFrame, balls_per_over: int = 6) -> DataFrame:
    """Runs, wickets, legal balls and overs in cricket notation (never to be summed)."""
    return (
        d.groupBy("format", *INNINGS, "batting_team")
        .agg(r.total("runs_total").alias("runs"), r.count_if(F.col("is_wicket")).alias("wickets"), r.count_if(r.legal_ball()).alias("balls"), r.total("runs_extras").alias("extras"))
        .withColumn("overs", (F.floor(F.col("balls") / balls_per_over) * 10 + F.col("balls") % balls_per_over) / F.lit(10.0))
    )


def maidens(d: DataFrame, balls_per_over: int = 6) -> DataFrame:
    """Overs of one bowler with all their legal balls and nothing charged, per bowler and innings."""
    overs = d.groupBy(*INNINGS, "bowler", "over_number").agg(r.count_if(r.legal_ball()).alias("balls"), r.total(r.bowler_runs()).alias("charged"))
    return overs.groupBy(*INNINGS, "bowler").agg(r.count_if((F.col("balls") >= balls_per_over) & (F.col("charged") == 0)).alias("maidens"))


def scorecard_batting(d: DataFrame) -> DataFrame:
    """The batting card: everyone who comes in to bat, in order of appearance, the striker before the non-striker of a ball."""
    at = F.col("over_number") * 1000 + F.col("ball_in_over")
    keys = [*INNINGS, "batting_team"]
    seen = F.array(
        F.struct(F.col("batter").alias("player"), F.lit(0).alias("role"), F.lit(True).alias("striker"), (r.batter_out() & (F.coalesce("dismissed_player", "batter") == F.col("batter"))).alias("gone")),
        F.struct(F.col("non_striker").alias("player"), F.lit(1).alias("role"), F.lit(False).alias("striker"), (r.batter_out() & (F.col("dismissed_player") == F.col("non_striker"))).alias("gone")),
    )
    each = d.select(*keys, at.alias("at"), "runs_batter", "wicket_type", "bowler", "fielder", r.ball_faced().alias("faced"), r.boundary(4).alias("four"), r.boundary(6).alias("six"), r.bowler_wicket().alias("credited"), F.inline(seen))
    each = each.where(F.col("player").isNotNull())
    end = F.min(F.when(F.col("gone"), F.struct("at", "wicket_type", F.when(F.col("credited"), F.col("bowler")).alias("bowler"), "fielder")))
    card = each.groupBy(*keys, "player").agg(
        r.total(F.when(F.col("striker"), F.col("runs_batter")).otherwise(0)).alias("runs"),
        r.count_if(F.col("striker") & F.col("faced")).alias("balls"),
        r.count_if(F.col("striker") & F.col("four")).alias("fours"),
        r.count_if(F.col("striker") & F.col("six")).alias("sixes"),
        F.min(F.struct("at", "role")).alias("first"),
        end.alias("end"),
    )
    place = F.row_number().over(Window.partitionBy(*INNINGS).orderBy("first", "player"))
    return card.select(*keys, "player", "runs", "balls", "fours", "sixes", place.alias("position"), F.col("end").isNull().alias("not_out"), F.col("end.wicket_type").alias("kind"), F.col("end.bowler").alias("out_to"), F.col("end.fielder").alias("fielder"))


def scorecard_bowling(d: DataFrame, balls_per_over: int = 6) -> DataFrame:
    """The bowling card with maidens, in order of the first ball bowled: over sums first, then the card, in two steps."""
    keys = [*INNINGS, "bowling_team", "bowler"]
    overs = d.groupBy(*keys, "over_number").agg(
        r.count_if(r.legal_ball()).alias("balls"), r.total(r.bowler_runs()).alias("charged"), r.count_if(r.bowler_wicket()).alias("wickets"), r.total("extras_wides").alias("wides"), r.total("extras_noballs").alias("noballs"), F.min("ball_in_over").alias("first")
    )
    card = overs.groupBy(*keys).agg(
        r.total("balls").alias("balls"), r.total("charged").alias("conceded"), r.total("wickets").alias("wickets"), r.total("wides").alias("wides"), r.total("noballs").alias("noballs"),
        r.count_if((F.col("balls") >= balls_per_over) & (F.col("charged") == 0)).alias("maidens"), F.min(F.struct("over_number", "first")).alias("first"),
    )
    place = F.row_number().over(Window.partitionBy(*INNINGS).orderBy("first", "bowler"))
    return card.withColumn("position", place).drop("first")


def dismissal_text(card: DataFrame) -> DataFrame:
    """card with how the player was out, as in a scorecard."""
    k, b, f = F.coalesce("kind", F.lit("")), F.coalesce("out_to", F.lit("")), F.coalesce("fielder", F.lit(""))
    text = (
        F.when(F.col("not_out"), "not out")
        .when(k == "caught", F.concat(F.lit("c "), f, F.lit(" b "), b))
        .when(k == "stumped", F.concat(F.lit("st "), f, F.lit(" b "), b))
        .when(k == "lbw", F.concat(F.lit("lbw b "), b))
        .when(k == "bowled", F.concat(F.lit("b "), b))
        .when(k == "run out", F.concat(F.lit("run out ("), f, F.lit(")")))
        .otherwise(k)
    )
    return card.withColumn("dismissal", text)


def by_ranges(d: DataFrame) -> DataFrame:
    """d with phase, by a join with the table of each format's ranges of overs; formats that aren't listed go by T20."""
    rows = [(f, "general", 0, 1000) for f in r.MULTI_DAY]
    for f, (first, second) in r.PHASES.items():
        rows += [(f, "powerplay", 0, first), (f, "middle", first + 1, second), (f, "death", second + 1, 1000)]
    ranges = d.sparkSession.createDataFrame(rows, "_f string, phase string, _low int, _high int")
    own = F.when(F.col("format").isin(*r.MULTI_DAY, *r.PHASES), F.col("format")).otherwise("T20")
    return d.withColumn("_own", own).join(F.broadcast(ranges), (F.col("_own") == F.col("_f")) & F.col("over_number").between(F.col("_low"), F.col("_high"))).drop("_own", "_f", "_low", "_high")  # a row a phase


def denormalised(balls: DataFrame, inn: DataFrame, matches: DataFrame, players: DataFrame, teams: DataFrame, venues: DataFrame) -> DataFrame:
    """Balls with the names that their keys stand for; keys without a name give null. The three last: (id, name)."""
    out = balls.join(inn.withColumnRenamed("id", "innings_id"), "innings_id").join(matches, "match_id")
    for names, columns in ((players, ("batter", "bowler", "non_striker", "dismissed_player")), (teams, ("batting_team", "bowling_team", "winner")), (venues, ("venue",))):
        for c in columns:
            out = out.join(names.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c)), f"{c}_id", "left")
    return out.select("match_id", "innings_number", "over_number", "ball_in_over", "format", "match_date", "venue", "batting_team", "bowling_team", "batter", "bowler", "non_striker", "dismissed_player", "runs_total", "winner")

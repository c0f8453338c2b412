"""Career, period and matchup aggregates of players.

Inputs are the lines of wicketflow.operators.innings (batting_lines, bowling_lines) or deliveries. A player-format key is the
widest group and is far from one task's size; aggregates are partial on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.functions import rules as r


def career_batting(lines: DataFrame, keys: tuple[str, ...] = ("player", "format")) -> DataFrame:
    """lines: batting_lines(); keys: what a career is cut by."""
    return (
        lines.groupBy(*keys)
        .agg(
            F.countDistinct("match_id").alias("matches"),
            F.count("*").alias("innings"),
            r.total("runs").alias("runs"),
            r.total("balls").alias("balls"),
            r.total("fours").alias("fours"),
            r.total("sixes").alias("sixes"),
            r.count_if(~F.col("out")).alias("not_outs"),
            F.max("runs").alias("highest"),
            r.count_if((F.col("runs") >= 50) & (F.col("runs") < 100)).alias("fifties"),
            r.count_if(F.col("runs") >= 100).alias("hundreds"),
        )
        .withColumn("average", r.ratio(F.col("runs"), F.col("innings") - F.col("not_outs")))
        .withColumn("strike_rate", r.ratio(F.col("runs"), F.col("balls"), 100))
    )


def career_bowling(lines: DataFrame, keys: tuple[str, ...] = ("bowler", "format")) -> DataFrame:
    """lines: bowling_lines(). Best figures: most wickets, then fewest runs."""
    best = F.min(F.struct((-F.col("wickets")).alias("w"), F.col("conceded").alias("r")))
    return (
        lines.groupBy(*keys)
        .agg(
            F.countDistinct("match_id").alias("matches"),
            F.count("*").alias("innings"),
            r.total("balls").alias("balls"),
            r.total("conceded").alias("conceded"),
            r.total("wickets").alias("wickets"),
            r.total("dots").alias("dots"),
            r.count_if(F.col("wickets") == 4).alias("fours_w"),
            r.count_if(F.col("wickets") >= 5).alias("fives_w"),
            best.alias("best"),
        )
        .withColumn("best_wickets", -F.col("best.w"))
        .withColumn("best_runs", F.col("best.r"))
        .drop("best")
        .withColumn("economy", r.ratio(F.col("conceded"), F.col("balls"), 6))
        .withColumn("average", r.ratio(F.col("conceded"), F.col("wickets")))
        .withColumn("strike_rate", r.ratio(F.col("balls"), F.col("wickets")))
    )


def by_phase(d: DataFrame, *, bowling: bool = False) -> DataFrame:
    """A player's balls, runs and rates in each phase of the innings."""
    who = F.col("bowler" if bowling else "batter").alias("player")
    counted = r.legal_ball() if bowling else r.ball_faced()
    runs = r.bowler_runs() if bowling else F.col("runs_batter")
    out = d.groupBy(who, "format", r.phase().alias("phase")).agg(
        r.total(runs).alias("runs"), r.count_if(counted).alias("balls"), r.count_if(counted & (F.col("runs_total") == 0)).alias("dots"), r.count_if(r.bowler_wicket()).alias("wickets"), r.count_if(r.boundary(4) | r.boundary(6)).alias("boundaries")
    )
    return out.withColumn("rate", r.ratio(F.col("runs"), F.col("balls"), 6 if bowling else 100))


def by_situation(lines: DataFrame) -> DataFrame:
    """Setting against chasing; chasing is the second innings only."""
    side = F.when(F.col("innings_number") == 2, "chasing").otherwise("setting")
    return lines.groupBy("player", "format", side.alias("situation")).agg(F.count("*").alias("innings"), r.total("runs").alias("runs"), r.total("balls").alias("balls"), r.count_if(F.col("out")).alias("outs")).withColumn(
        "average", r.ratio(F.col("runs"), F.col("outs"))
    )


def consistency(lines: DataFrame, least: int = 5) -> DataFrame:
    """100 (1 - deviation / mean) of runs an innings, not below 0, for players with enough innings."""
    a = lines.groupBy("player", "format").agg(F.count("*").alias("innings"), F.avg("runs").alias("mean"), F.stddev_samp("runs").alias("deviation")).where(F.col("innings") >= least)
    score = F.when(F.col("mean") > 0, F.greatest(F.lit(0.0), (1 - F.col("deviation") / F.col("mean")) * 100))
    return a.withColumn("consistency", score)


def recent_batting(lines: DataFrame, days: int = 548, asof: Column | None = None) -> DataFrame:
    """The last days before asof (default: the latest date in the data), with median and deviation of runs."""
    last = lines.agg(F.max("match_date").alias("asof"))
    rows = lines.crossJoin(F.broadcast(last)) if asof is None else lines.withColumn("asof", asof)  # one row
    return rows.where(F.col("match_date") >= F.date_sub("asof", days)).groupBy("player", "format").agg(
        F.count("*").alias("innings"), r.total("runs").alias("runs"), r.total("balls").alias("balls"), F.percentile_approx("runs", 0.5, 100_000).alias("median_runs"), F.max("match_date").alias("last_match")
    )


def matchups(d: DataFrame, least: int = 10, keys: tuple[str, ...] = ("batter", "bowler", "format")) -> DataFrame:
    """Batter against bowler in each format (keys: or a finer cut), pairs with at least so many balls."""
    return (
        d.where("batter is not null and bowler is not null and trim(batter) <> '' and trim(bowler) <> ''")
        .groupBy(*keys)
        .agg(
            F.countDistinct("match_id").alias("matches"),
            r.count_if(r.ball_faced()).alias("balls"),
            r.total("runs_batter").alias("runs"),
            r.count_if(r.bowler_wicket() & (F.col("dismissed_player") == F.col("batter"))).alias("dismissals"),
            r.count_if(r.ball_faced() & (F.col("runs_total") == 0)).alias("dots"),
            r.count_if(r.boundary(4) | r.boundary(6)).alias("boundaries"),
        )
        .where(F.col("balls") >= least)
        .withColumn("strike_rate", r.ratio(F.col("runs"), F.col("balls"), 100))
        .withColumn("average", r.ratio(F.col("runs"), F.col("dismissals")))
        .withColumn("dot_pct", r.ratio(F.col("dots"), F.col("balls"), 100))
        .withColumn("boundary_pct", r.ratio(F.col("boundaries"), F.col("balls"), 100))
    )


def style_class(style: str = "bowling_style") -> list[Column]:
    """Arm and pace or spin from the description of a bowling style."""
    s = F.lower(F.coalesce(F.col(style), F.lit("")))
    arm = F.when(s.startswith("left"), "left").when(s.startswith("right"), "right")
    pace = F.when(s.rlike("fast|medium|seam"), "pace").when(s.rlike("break|spin|orthodox|chinaman|googly|wrist"), "spin")
    return [arm.alias("arm"), pace.alias("pace_spin")]


def style_matchups(d: DataFrame, players: DataFrame, by: str) -> DataFrame:
    """Batter against the arm or the pace of bowlers; aggregates per bowler first, so the join carries few rows."""
    each = d.groupBy("batter", "bowler", "format").agg(r.count_if(r.ball_faced()).alias("balls"), r.total("runs_batter").alias("runs"), r.count_if(r.bowler_wicket()).alias("wickets"))
    styles = players.select(F.col("player").alias("bowler"), *style_class())
    out = each.join(styles, "bowler", "left").groupBy("batter", "format", by).agg(r.total("balls").alias("balls"), r.total("runs").alias("runs"), r.total("wickets").alias("wickets"))
    return out.withColumn("strike_rate", r.ratio(F.col("runs"), F.col("balls"), 100))


def recent_stats(batting: DataFrame, bowling: DataFrame, days: int = 548) -> DataFrame:
    """Batting and bowling of the last days before the latest date, and the last appearance, per player and format."""
    both = batting.select("player", "format", "match_id", "match_date", F.lit(1).alias("bat"), "runs", F.col("balls").alias("faced"), F.lit(0).alias("bowl"), F.lit(0).alias("wickets"), F.lit(0).alias("bowled"), F.lit(0).alias("conceded")).unionByName(
        bowling.select(F.col("bowler").alias("player"), "format", "match_id", "match_date", F.lit(0).alias("bat"), F.lit(0).alias("runs"), F.lit(0).alias("faced"), F.lit(1).alias("bowl"), "wickets", F.col("balls").alias("bowled"), "conceded")
    )
    rows = both.crossJoin(F.broadcast(both.agg(F.max("match_date").alias("asof")))).where(F.col("match_date") >= F.date_sub("asof", days))
    return rows.groupBy("player", "format").agg(
        F.countDistinct("match_id").alias("matches"), r.total("bat").alias("batting_innings"), r.total("runs").alias("runs"), r.total("faced").alias("balls_faced"), r.total("bowl").alias("bowling_innings"),
        r.total("wickets").alias("wickets"), r.total("bowled").alias("balls_bowled"), r.total("conceded").alias("runs_conceded"), F.max("match_date").alias("last_match_date"),
    )


def progression(lines: DataFrame) -> DataFrame:
    """Yearly figures with running totals."""
    w = Window.partitionBy("player", "format").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    yearly = lines.groupBy("player", "format", F.year("match_date").alias("year")).agg(F.count("*").alias("innings"), r.total("runs").alias("runs"))
    return yearly.withColumn("total_innings", F.sum("innings").over(w).cast("long")).withColumn("total_runs", F.sum("runs").over(w).cast("long"))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    """Mean of value weighted by a positive weight; null where no row has both."""
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    ok = (w > 0) & v.isNotNull()
    return F.sum(F.when(ok, v * w)) / F.nullif(F.sum(F.when(ok, w)), F.lit(0))


def merge_batting(chunks: DataFrame, most: int = 264) -> DataFrame:
    """Career rows of chunks of matches merged: additive columns summed, rates recomputed, impossible rows dropped."""
    ok = (F.col("not_outs") <= F.col("innings")) & (F.col("highest") <= most)
    return (
        chunks.where(ok)
        .groupBy("player", "format")
        .agg(*[r.total(c).alias(c) for c in ("matches", "innings", "runs", "balls", "fours", "sixes", "not_outs", "fifties", "hundreds")], F.max("highest").alias("highest"))
        .withColumn("average", r.ratio(F.col("runs"), F.col("innings") - F.col("not_outs")))
        .withColumn("strike_rate", r.ratio(F.col("runs"), F.col("balls"), 100))
    )

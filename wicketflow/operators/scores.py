"""Form, impact and ratings of players, computed from lines and careers.

Minima and maxima of a group are aggregates joined back; percentiles are running counts over ranges of values, so that
no step sorts all rows of a format, or of a season, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.sources.shared import staged

#: Weights of the form score and of the impact score's components.
FORM = {"recent": 0.35, "consistency": 0.20, "opposition": 0.15, "venue": 0.10, "situation": 0.10, "efficiency": 0.10}
IMPACT = {"performance": 0.35, "recent": 0.30, "pressure": 0.15, "opposition": 0.10, "consistency": 0.05, "efficiency": 0.05}
CONTEXT = ("recent", "consistency", "opposition", "venue", "situation", "efficiency")


def recent_innings(lines: DataFrame, n: int = 10) -> DataFrame:
    """The last n innings of each player and format."""
    w = Window.partitionBy("player", "format").orderBy(F.desc("match_date"), F.desc("match_id"), F.desc("innings_number"))
    return lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def form_inputs(lines: DataFrame, window: int = 10, least: int = 5) -> DataFrame:
    """The six raw inputs of the form score per player and format, in one pass per grouping.

    Ordered ranks, means by opponent and by venue are taken from the same lines; null where there are too few innings.
    """
    w = Window.partitionBy("player", "format").orderBy(F.desc("match_date"), F.desc("match_id"), F.desc("innings_number"))
    base = lines.withColumn("n", F.row_number().over(w)).groupBy("player", "format").agg(
        F.count("*").alias("innings"), r.total("runs").alias("runs"), r.total("balls").alias("balls"), F.avg("runs").alias("mean"), F.stddev_samp("runs").alias("deviation"),
        F.avg(F.when(F.col("n") <= window, F.col("runs"))).alias("recent_mean"), F.avg(F.when(F.col("innings_number") == 2, F.col("runs"))).alias("chase_mean"),
    )
    venues = lines.groupBy("player", "format", "venue").agg(F.avg("runs").alias("m")).groupBy("player", "format").agg(F.stddev_samp("m").alias("vd"), F.avg("m").alias("vm"))
    opp = lines.groupBy("player", "format", "bowling_team").agg(F.avg("runs").alias("m"), r.total("balls").alias("b")).groupBy("player", "format").agg((F.sum(F.col("m") * F.col("b")) / F.nullif(F.sum("b"), F.lit(0))).alias("opp_mean"))
    enough = F.col("innings") >= least
    return base.join(venues, ["player", "format"], "left").join(opp, ["player", "format"], "left").select(
        "player", "format", "innings",
        F.when(enough, F.col("recent_mean")).alias("recent"),
        F.when(enough & (F.col("mean") > 0), F.col("deviation") / F.col("mean")).alias("consistency"),
        F.col("opp_mean").alias("opposition"),
        F.when(F.col("vm") > 0, F.col("vd") / F.col("vm")).alias("venue"),
        F.when(F.col("mean") > 0, F.col("chase_mean") / F.col("mean")).alias("situation"),
        F.when(F.col("balls") > 0, F.col("runs") * 100.0 / F.col("balls") * F.col("mean") / 100).alias("efficiency"),
    )


def scaled(rows: DataFrame, keys: list[str], columns: dict[str, bool]) -> DataFrame:
    """rows with each column's place between its group's least (0) and greatest (100), as ``<column>_component``.

    columns: name -> whether the least is best. 50 where the group has one value only, or the row none.
    """
    ends = rows.groupBy(*keys).agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    out = rows.join(ends, keys)
    for c, invert in columns.items():
        x, low, high = F.col(c).cast("double"), F.col(f"_low_{c}"), F.col(f"_high_{c}")
        out = out.withColumn(f"{c}_component", F.coalesce(F.when(high > low, (high - x if invert else x - low) / (high - low) * 100), F.lit(50.0)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("low", "high")])


def _dealt(rows: DataFrame, ranges: int | None, *columns: str) -> DataFrame:
    """rows by ranges of columns: so many, or as many as the session's shuffle partitions, which Spark joins where they are small."""
    return rows.repartitionByRange(ranges, *columns) if ranges else rows.repartitionByRange(*columns)


def percentiles(rows: DataFrame, row: list[str], keys: list[str], values: dict[str, tuple[Column, bool]], *, alone: float | None = 50.0, ranges: int | None = None) -> DataFrame:
    """rows with ``<name>_rank`` for each of values: its percentile (0 to 100) within keys, ties at their mean rank.

    row: the columns that tell rows apart; values: name -> (column, whether the least is best). A null value has none.
    alone: the percentile where a group has one value only (None: 100). All values are ranked together: distinct values
    with their counts are dealt into ranges, and a value's rank is the count in the ranges before it and within its own.
    """
    rows = staged(rows, "ranked_rows")  # read three times
    kinds = F.array(*[F.struct(F.lit(n).alias("name"), (-v if invert else v).cast("double").alias("value")) for n, (v, invert) in values.items()])
    long = rows.select(*row, *[k for k in keys if k not in row], F.inline(kinds)).where("value is not null")
    group = [*keys, "name"]
    counted = long.groupBy(*group, "value").agg(F.count("*").alias("n"))
    dealt = _dealt(counted, ranges, *group, "value").withColumn("part", F.spark_partition_id())
    dealt = staged(dealt, "ranges")  # the parts stay as they are
    own = Window.partitionBy("part", *group).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    parts = dealt.groupBy(*group, "part").agg(F.sum("n").alias("in_part"))  # a row a group and range
    all_ = Window.partitionBy(*group)
    parts = parts.select(*group, "part", F.coalesce(F.sum("in_part").over(all_.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("in_part").over(all_).alias("total"))
    within = dealt.withColumn("upto", F.sum("n").over(own)).join(parts, [*group, "part"])
    score = (F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0) / F.col("total") * 100
    if alone is not None:
        score = F.when(F.col("total") == 1, F.lit(float(alone))).otherwise(score)
    scores = long.join(within.select(*group, "value", score.alias("score")), [*group, "value"])
    wide = scores.groupBy(*row).agg(*[F.max(F.when(F.col("name") == n, F.col("score"))).alias(f"{n}_rank") for n in values])
    return rows.join(wide, row, "left")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], into: str = "n", *, ranges: int | None = None) -> DataFrame:
    """rows with into: the place within keys by order (which tells all rows of a key apart), from 1.

    Rows are dealt into ranges of the order; a row's place is the number of rows in the ranges before its own, and within it.
    """
    names = [f"_o{i}" for i in range(len(order))]
    dealt = rows.select("*", *[o.alias(n) for o, n in zip(order, names)])
    dealt = _dealt(dealt, ranges, *keys, *names).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, "ranges")  # the parts stay as they are
    sizes = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))  # a row a key and range
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*names))
    out = dealt.withColumn("_own", own).join(sizes.select(*keys, "_part", before.alias("_before")), [*keys, "_part"])
    return out.withColumn(into, (F.col("_before") + F.col("_own")).cast("int")).drop("_part", "_own", "_before", *names)


def form_score(inputs: DataFrame) -> DataFrame:
    """Six components scaled 0 to 100 in their format (missing: 50) and their weighted sum."""
    out = scaled(inputs, ["format"], {k: k in ("consistency", "venue") for k in FORM}).select("player", "format", *[f"{k}_component" for k in FORM])
    return out.withColumn("form_score", sum((F.col(f"{k}_component") * w for k, w in FORM.items()), F.lit(0.0)))


def opposition_strength(bowling: DataFrame) -> DataFrame:
    """Of each bowling side and format: the mean of its scaled economy (low is good) and wickets an over. bowling: bowling_lines()."""
    sums = bowling.groupBy("bowling_team", "format").agg(r.total("balls").alias("balls"), r.total("conceded").alias("conceded"), r.total("wickets").alias("wickets"))
    rates = sums.withColumn("economy", r.ratio(F.col("conceded"), F.col("balls"), 6)).withColumn("wicket_rate", F.coalesce(r.ratio(F.col("wickets"), F.col("balls"), 6), F.lit(0.0)))
    out = scaled(rates, ["format"], {"economy": True, "wicket_rate": False})
    return out.select("bowling_team", "format", "balls", "economy", "wicket_rate", ((F.col("economy_component") + F.col("wicket_rate_component")) / 2).alias("strength"))


def impact_context(batting: DataFrame, bowling: DataFrame, *, window: int = 10, least: int = 3) -> DataFrame:
    """What surrounds a player's batting in a format, for players with enough innings: six inputs and their scaled values.

    Lines are dealt by player and format once: the last innings, the venues and the sums follow from that dealing. recent:
    mean of the last innings; consistency: 100 (1 - deviation / mean), not below 0; opposition: strength of the sides faced,
    weighted by balls; venue: as consistency, over the venues' means (one venue: 50); situation: mean of second innings to
    all (fewer than two, or a multi-day format: 1); efficiency: strike rate times mean. Innings without a ball faced count not.
    """
    w = Window.partitionBy("player", "format").orderBy(F.desc("match_date"), F.desc("match_id"), F.desc("innings_number"))
    lines = batting.where("balls > 0").join(opposition_strength(bowling).select("bowling_team", "format", "strength"), ["bowling_team", "format"], "left")
    x, second = F.col("runs").cast("double"), F.col("innings_number") == 2
    by_venue = lines.repartition("player", "format").withColumn("n", F.row_number().over(w)).groupBy("player", "format", "venue").agg(
        F.count("*").alias("innings"), F.sum(x).alias("runs"), F.sum(x * x).alias("squares"), F.sum("balls").alias("balls"), F.sum(F.coalesce("strength", F.lit(50.0)) * F.col("balls")).alias("faced"),
        F.sum(F.when(F.col("n") <= window, x)).alias("last_runs"), r.count_if(F.col("n") <= window).alias("last"), F.sum(F.when(second, x)).alias("chase_runs"), r.count_if(second).alias("chases"), F.max("match_date").alias("day"),
    )
    mean = F.col("runs") / F.col("innings")
    total = by_venue.groupBy("player", "format").agg(
        *[F.sum(c).alias(c) for c in ("innings", "runs", "squares", "balls", "faced", "last_runs", "last", "chase_runs", "chases")], F.count("*").alias("venues"), F.avg(mean).alias("venue_mean"), F.stddev_samp(mean).alias("venue_deviation"), F.max("day").alias("last_match_date")
    )
    spread = F.sqrt(F.greatest(F.col("squares") - F.col("runs") * mean, F.lit(0.0)) / (F.col("innings") - 1))
    even = lambda deviation, middle: F.greatest(F.lit(0.0), (1 - deviation / middle) * 100)
    inputs = total.where(F.col("innings") >= least).select(
        "player", "format", "innings", F.col("last").alias("recent_innings"), "last_match_date", (F.col("last_runs") / F.col("last")).alias("recent"),
        F.when(mean > 0, even(spread, mean)).otherwise(0.0).alias("consistency"), (F.col("faced") / F.col("balls")).alias("opposition"),
        F.when((F.col("venues") > 1) & (F.col("venue_mean") > 0), even(F.col("venue_deviation"), F.col("venue_mean"))).otherwise(50.0).alias("venue"),
        F.when(~F.col("format").isin(*r.MULTI_DAY) & (F.col("chases") >= 2) & (mean > 0), F.col("chase_runs") / F.col("chases") / mean).otherwise(1.0).alias("situation"),
        (F.col("runs") * 100 / F.col("balls") * mean / 100).alias("efficiency"),
    )
    return scaled(inputs, ["format"], dict.fromkeys(CONTEXT, False))


def combine_roles(a: Column, b: Column) -> Column:
    """0.75 of the better role and 0.25 of the other; one alone counts in full; none is 50."""
    both = 0.75 * F.greatest(a, b) + 0.25 * F.least(a, b)
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), both), a, b, F.lit(50.0))


def shrink(score: Column, n: Column, k: float) -> Column:
    """Pulled to 50 by k pseudo-observations."""
    return 50 + (score - 50) * n / (n + F.lit(float(k)))


def career_rows(rows: DataFrame, sums: list[str], means: list[str]) -> DataFrame:
    """One row a player and format from career rows that may be split: counts summed, rates averaged."""
    return rows.groupBy("player", "format").agg(*[r.total(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])


def role_impact(rows: DataFrame, row: list[str], keys: list[str], alone: float | None = 50.0) -> DataFrame:
    """rows with b and w: batting and bowling impact within keys, shrunk by innings; null for a role with under 3 innings.

    rows need bi, ba, bs, bv (innings, average, strike rate and log of runs) and wi, wb, wn, we (innings, balls, wickets, economy).
    """
    bats, bowls = F.col("bi") >= 3, (F.col("wi") >= 3) & (F.col("wb") > 0)
    of = lambda ok, c: F.when(ok, c)
    values = {
        "ba": (of(bats, F.col("ba")), False), "bs": (of(bats, F.col("bs")), False), "bv": (of(bats, F.col("bv")), False),
        "wr": (of(bowls, F.col("wn") / F.col("wi")), False), "we": (of(bowls, F.col("we")), True), "wv": (of(bowls, F.log1p("wn")), False),
    }
    x = percentiles(rows, row, keys, values, alone=alone)
    b = 0.45 * F.col("ba_rank") + 0.25 * F.col("bs_rank") + 0.30 * F.col("bv_rank")
    w = 0.45 * F.col("wr_rank") + 0.25 * F.col("we_rank") + 0.30 * F.col("wv_rank")
    return x.withColumn("b", shrink(b, F.col("bi"), 8)).withColumn("w", shrink(w, F.col("wi"), 8))


def impact_score(batting: DataFrame, bowling: DataFrame, recent: DataFrame, context: DataFrame) -> DataFrame:
    """Role-aware impact per player and format, 0 to 100.

    batting, bowling: careers keyed (player, format); recent: recent_stats(); context: impact_context(), which adds to
    players of the other three and brings in none. Percentiles are taken within the format; performance and recent form of
    both roles are combined and pulled to 50 where there are few innings or matches.
    """
    key = ["player", "format"]
    bat = batting.select(*key, F.col("innings").alias("bi"), F.log1p("runs").alias("bv"), F.coalesce("average", F.col("runs").cast("double")).alias("ba"), F.coalesce("strike_rate", F.lit(0.0)).alias("bs"))
    bowl = bowling.withColumnRenamed("bowler", "player").select(*key, F.col("innings").alias("wi"), F.col("balls").alias("wb"), F.col("wickets").alias("wn"), F.col("economy").alias("we"))
    rec = recent.select(
        *key, F.col("matches").alias("rm"), F.col("batting_innings").alias("rbi"), r.ratio(F.col("runs"), F.col("batting_innings")).alias("rb"), r.ratio(F.col("runs"), F.col("balls_faced"), 100).alias("rs"),
        F.col("bowling_innings").alias("rwi"), F.col("balls_bowled").alias("rwb"), r.ratio(F.col("wickets"), F.col("bowling_innings")).alias("rw"), r.ratio(F.col("runs_conceded"), F.col("balls_bowled"), 6).alias("re"),
    )
    ctx = context.select(*key, *[F.col(f"{k}_component").alias(k) for k in CONTEXT])
    x = role_impact(bat.join(bowl, key, "full").join(rec, key, "full").join(ctx, key, "left"), key, ["format"])
    bats, bowls = F.col("rbi") >= 2, (F.col("rwi") >= 2) & (F.col("rwb") > 0)
    x = percentiles(x, key, ["format"], {"rb": (F.when(bats, F.col("rb")), False), "rs": (F.when(bats, F.col("rs")), False), "rw": (F.when(bowls, F.col("rw")), False), "re": (F.when(bowls, F.col("re")), True)})
    form = combine_roles(0.65 * F.col("rb_rank") + 0.35 * F.col("rs_rank"), 0.65 * F.col("rw_rank") + 0.35 * F.col("re_rank"))
    half = lambda k: F.greatest(F.least(F.coalesce(k, F.lit(50.0)), F.lit(100.0)), F.lit(0.0))
    out = x.select(
        *key, combine_roles(F.col("b"), F.col("w")).alias("performance"), F.when(F.col("rm") > 0, shrink(form, F.col("rm"), 5)).otherwise(F.coalesce("recent", F.lit(50.0))).alias("recent"),
        half("situation").alias("pressure"), half("opposition").alias("opposition"), half("consistency").alias("consistency"), half("efficiency").alias("efficiency"), (F.coalesce("bi", F.lit(0)) + F.coalesce("wi", F.lit(0))).alias("innings"),
    )
    return out.withColumn("impact", sum((F.col(k) * v for k, v in IMPACT.items()), F.lit(0.0)))


def season_impact(batting: DataFrame, bowling: DataFrame, keys: list[str]) -> DataFrame:
    """Impact within one edition (keys) alone, from both roles; null for players with under 3 innings in each."""
    row = ["player", *keys]
    bat = batting.select(*row, F.col("innings").alias("bi"), F.log1p("runs").alias("bv"), F.col("average").alias("ba"), F.col("strike_rate").alias("bs"))
    bowl = bowling.withColumnRenamed("bowler", "player").select(*row, F.col("innings").alias("wi"), F.col("balls").alias("wb"), F.col("wickets").alias("wn"), F.col("economy").alias("we"))
    x = role_impact(bat.join(bowl, row, "full"), row, keys, alone=None)
    return x.select(*row, F.when(F.col("b").isNotNull() | F.col("w").isNotNull(), combine_roles(F.col("b"), F.col("w"))).alias("impact"))


def roles(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """(player, format, role): bowlers have bowled 30 balls, allrounders have five innings with the bat besides."""
    key = ["player", "format"]
    both = batting.select(*key, F.col("innings").alias("bi")).join(bowling.withColumnRenamed("bowler", "player").select(*key, "balls"), key, "full")
    bowls = F.coalesce("balls", F.lit(0)) >= 30
    return both.select(*key, F.when(bowls & (F.coalesce("bi", F.lit(0)) >= 5), "allrounder").when(bowls, "bowler").otherwise("batter").alias("role"))


def ranked(rows: DataFrame, rating: Column, n: int, least: int = 5) -> DataFrame:
    """The n best players of each format with their places; ties by name. Spark cuts to n a task before it shuffles."""
    w = Window.partitionBy("format").orderBy(F.desc_nulls_last("rating"), "player")
    rows = rows.where(F.col("innings") >= least) if least else rows
    return rows.withColumn("rating", rating).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("format", "rank", "player", "rating")


def batting_rating() -> Column:
    """Of a row with average, strike_rate and impact (50 where there is none)."""
    return 0.4 * F.coalesce("average", F.lit(0.0)) + 0.3 * F.coalesce("strike_rate", F.lit(0.0)) + 0.3 * F.coalesce("impact", F.lit(50.0))


def bowling_rating() -> Column:
    """Of a row with wickets, economy, average and impact; economy counts below 10 and the average below 30."""
    return 0.3 * F.col("wickets") + 2.5 * (10 - F.least(F.coalesce("economy", F.lit(15.0)), F.lit(10.0))) + 0.15 * (30 - F.least(F.coalesce("average", F.lit(60.0)), F.lit(30.0))) + 0.3 * F.coalesce("impact", F.lit(50.0))


def allround_rating() -> Column:
    """Of a row with average, strike_rate, wickets and impact."""
    return 0.25 * F.coalesce("average", F.lit(0.0)) + 0.15 * F.coalesce("strike_rate", F.lit(0.0)) + 0.3 * F.coalesce("wickets", F.lit(0)) + 0.3 * F.coalesce("impact", F.lit(50.0))

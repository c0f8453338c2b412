"""Match results, teams and venues.

Matches are one row each with first and second innings totals; a team's view of them comes from one explode of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.functions import rules as r


def match_totals(d: DataFrame) -> DataFrame:
    """Both innings of a match in one row, by conditional aggregation."""
    one, two = F.col("innings_number") == 1, F.col("innings_number") == 2
    return d.groupBy("match_id", "format", "venue", "team_a", "team_b").agg(
        r.total(F.when(one, F.col("runs_total")).otherwise(0)).alias("first_runs"),
        r.total(F.when(two, F.col("runs_total")).otherwise(0)).alias("second_runs"),
        r.count_if(one & F.col("is_wicket")).alias("first_wickets"),
        r.count_if(two & F.col("is_wicket")).alias("second_wickets"),
    )


def match_results(totals: DataFrame) -> DataFrame:
    """Winner (null on a tie), the way and the margin: runs for the side batting first, wickets for the other."""
    a, b = F.col("first_runs"), F.col("second_runs")
    return (
        totals.withColumn("winner", F.when(a > b, F.col("team_a")).when(b > a, F.col("team_b")))
        .withColumn("win_type", F.when(a > b, "runs").when(b > a, "wickets").otherwise("tie"))
        .withColumn("margin", F.when(a > b, a - b).when(b > a, 10 - F.col("second_wickets")))
    )


def result_text() -> Column:
    """A sentence for a row of matches with its margin."""
    unit = F.when(F.col("winner") == F.col("team_a"), F.concat((F.col("first_runs") - F.col("second_runs")).cast("string"), F.lit(" runs"))).otherwise(
        F.concat((10 - F.col("second_wickets")).cast("string"), F.lit(" wickets"))
    )
    return (
        F.when(F.col("result_type") == "win", F.concat("winner", F.lit(" won by "), unit))
        .when(F.col("result_type") == "draw", "Match drawn")
        .when(F.col("result_type") == "tie", "Match tied")
        .when(F.col("result_type") == "abandoned", "Match abandoned")
        .otherwise("No result")
    )


def perspectives(matches: DataFrame) -> DataFrame:
    """Each match once for each of its teams."""
    side = lambda own, other, runs, against, chased: F.struct(F.col(own).alias("team"), F.col(other).alias("opponent"), F.col(runs).alias("scored"), F.col(against).alias("allowed"), F.lit(chased).alias("chased"))
    both = F.array(side("team_a", "team_b", "first_runs", "second_runs", False), side("team_b", "team_a", "second_runs", "first_runs", True))
    kept = [c for c in matches.columns if c not in ("first_runs", "second_runs", "second_wickets", "team_a", "team_b")]
    return matches.select(*kept, F.inline(both))


def team_records(sides: DataFrame, *keys: str) -> DataFrame:
    """Wins, losses, draws, ties and no results; ties and draws aren't losses."""
    won = F.col("winner") == F.col("team")
    return (
        sides.groupBy("team", *keys)
        .agg(
            F.count("*").alias("matches"),
            r.count_if((F.col("result_type") == "win") & won).alias("wins"),
            r.count_if((F.col("result_type") == "win") & ~won).alias("losses"),
            r.count_if(F.col("result_type") == "draw").alias("draws"),
            r.count_if(F.col("result_type") == "tie").alias("ties"),
            r.count_if(F.col("result_type").isin("no_result", "abandoned")).alias("no_results"),
        )
        .withColumn("win_rate", r.ratio(F.col("wins"), F.col("matches"), 100))
    )


def team_performance(sides: DataFrame) -> DataFrame:
    """Records, average scores, and how often chases and defences succeed, per team and format."""
    won = (F.col("result_type") == "win") & (F.col("winner") == F.col("team"))
    return sides.groupBy("team", "format").agg(
        F.count("*").alias("matches"), r.count_if(won).alias("wins"), r.total("scored").alias("runs"), r.total("allowed").alias("runs_against"), F.max("scored").alias("highest"), F.min("scored").alias("lowest"),
        r.count_if(F.col("chased")).alias("chases"), r.count_if(F.col("chased") & won).alias("chases_won"), r.count_if(~F.col("chased")).alias("defences"), r.count_if(~F.col("chased") & won).alias("defences_won"),
    ).withColumn("avg_score", r.ratio(F.col("runs"), F.col("matches"))).withColumn("chase_pct", r.ratio(F.col("chases_won"), F.col("chases"), 100)).withColumn("defend_pct", r.ratio(F.col("defences_won"), F.col("defences"), 100))


def team_bowling(d: DataFrame) -> DataFrame:
    return d.groupBy(F.col("bowling_team").alias("team"), "format").agg(r.count_if(r.legal_ball()).alias("balls"), r.total(r.bowler_runs()).alias("conceded"), r.count_if(r.bowler_wicket()).alias("wickets"), r.count_if(r.legal_ball() & (F.col("runs_total") == 0)).alias("dots")).withColumn(
        "economy", r.ratio(F.col("conceded"), F.col("balls"), 6)
    )


def team_phases(d: DataFrame, *, bowling: bool = False) -> DataFrame:
    team = F.col("bowling_team" if bowling else "batting_team").alias("team")
    runs = r.bowler_runs() if bowling else F.col("runs_total")
    lost = r.bowler_wicket() if bowling else F.col("is_wicket")
    out = d.groupBy(team, "format", r.phase().alias("phase")).agg(F.countDistinct("match_id").alias("matches"), r.total(runs).alias("runs"), r.count_if(r.legal_ball()).alias("balls"), r.count_if(lost).alias("wickets"))
    return out.withColumn("runs_per_match", r.ratio(F.col("runs"), F.col("matches"))).withColumn("economy", r.ratio(F.col("runs"), F.col("balls"), 6))


def minmax(column: str, *keys: str, invert: bool = False) -> Column:
    """0 to 100 within keys; 50 where the range is 0 or the value is null. A window, nothing goes to the driver."""
    w, x = Window.partitionBy(*keys), F.col(column).cast("double")
    low, high = F.min(x).over(w), F.max(x).over(w)
    scaled = F.when(high > low, (high - x if invert else x - low) / (high - low) * 100)
    return F.coalesce(scaled, F.lit(50.0))


def team_strength(performance: DataFrame, bowling: DataFrame) -> DataFrame:
    """0.35 batting + 0.35 bowling + 0.30 win rate, each scaled within the format."""
    both = performance.join(bowling.select("team", "format", "economy"), ["team", "format"], "left").withColumn("win_rate", r.ratio(F.col("wins"), F.col("matches"), 100))
    scored = both.withColumn("batting_score", minmax("avg_score", "format")).withColumn("bowling_score", minmax("economy", "format", invert=True))
    return scored.select("team", "format", "batting_score", "bowling_score", (0.35 * F.col("batting_score") + 0.35 * F.col("bowling_score") + 0.30 * F.col("win_rate")).alias("strength"))


def head_to_head(matches: DataFrame) -> DataFrame:
    """Per unordered pair of teams and format."""
    one, two = F.least("team_a", "team_b"), F.greatest("team_a", "team_b")
    return matches.groupBy(one.alias("team_1"), two.alias("team_2"), "format").agg(
        F.count("*").alias("matches"), r.count_if((F.col("result_type") == "win") & (F.col("winner") == one)).alias("wins_1"), r.count_if((F.col("result_type") == "win") & (F.col("winner") == two)).alias("wins_2"),
        r.count_if(F.col("result_type") == "draw").alias("draws"), r.count_if(F.col("result_type") == "tie").alias("ties"),
    )


def venue_balls(d: DataFrame) -> DataFrame:
    """All ball-level metrics of a venue and format in one pass, phases as columns."""
    ph = r.phase()
    names = ("powerplay", "middle", "death", "general")
    return d.groupBy("venue", "format").agg(
        F.countDistinct("match_id").alias("matches"),
        r.total("runs_total").alias("runs"),
        r.count_if(r.legal_ball()).alias("balls"),
        r.count_if(r.bowler_wicket()).alias("wickets"),
        r.count_if(r.boundary(4)).alias("fours"),
        r.count_if(r.boundary(6)).alias("sixes"),
        *[r.total(F.when(ph == p, F.col("runs_total")).otherwise(0)).alias(f"{p}_runs") for p in names],
    ).withColumn("run_rate", r.ratio(F.col("runs"), F.col("balls"), 6)).withColumn("boundaries_per_match", r.ratio(F.col("fours") + F.col("sixes"), F.col("matches")))


def venue_matches(matches: DataFrame) -> DataFrame:
    """Match-level metrics of a venue and format: scores, chases, tosses; 50 where nothing was decided."""
    chase, defend = (F.col("result_type") == "win") & (F.col("winner") == F.col("team_b")), (F.col("result_type") == "win") & (F.col("winner") == F.col("team_a"))
    out = matches.groupBy("venue", "format").agg(
        F.count("*").alias("matches"), r.total("first_runs").alias("first_runs"), r.total("second_runs").alias("second_runs"), F.max(F.greatest("first_runs", "second_runs")).alias("highest"), F.min(F.least("first_runs", "second_runs")).alias("lowest"),
        r.count_if(chase).alias("chases_won"), r.count_if(defend).alias("defences_won"), r.count_if((F.col("toss_decision") == "bat")).alias("bat_first_tosses"), r.count_if((F.col("result_type") == "win") & (F.col("winner") == F.col("toss_winner"))).alias("toss_wins"),
    )
    decided = F.col("chases_won") + F.col("defences_won")
    return out.withColumn("avg_first", r.ratio(F.col("first_runs"), F.col("matches"))).withColumn("chase_pct", F.coalesce(r.ratio(F.col("chases_won"), decided, 100), F.lit(50.0)))


def venue_toss(matches: DataFrame) -> DataFrame:
    return matches.groupBy("venue", "toss_decision").agg(F.count("*").alias("matches"), r.count_if((F.col("result_type") == "win") & (F.col("winner") == F.col("toss_winner"))).alias("won"))


def score_lines(d: DataFrame) -> DataFrame:
    """One text such as ``250/7 & 180/10`` for each team of a match, its innings in order."""
    each = d.groupBy("match_id", "batting_team", "innings_number").agg(r.total("runs_total").alias("runs"), r.count_if(F.col("is_wicket")).alias("wickets"))
    text = F.concat_ws("/", F.col("runs").cast("string"), F.col("wickets").cast("string"))
    order = F.sort_array(F.collect_list(F.struct("innings_number", text.alias("text"))))  # at most a few innings
    return each.groupBy("match_id", "batting_team").agg(F.array_join(F.transform(order, lambda x: x["text"]), " & ").alias("score"))


def between_members(matches: DataFrame, members: list[str]) -> DataFrame:
    """Matches whose two teams are both members (a short list of names)."""
    return matches.where(F.col("team_a").isin(*members) & F.col("team_b").isin(*members))


def team_summary(sides: DataFrame, d: DataFrame) -> DataFrame:
    """team_performance() with losses, ties, draws and no results, runs and balls of each phase, and the team's strength."""
    key = ["team", "format"]
    perf = team_performance(sides)
    records = team_records(sides, "format").select(*key, "losses", "ties", "draws", "no_results")
    legal, phase = r.legal_ball(), r.phase()
    parts = [x for p in ("powerplay", "middle", "death") for x in (r.total(F.when(phase == p, F.col("runs_total")).otherwise(0)).alias(f"{p}_runs"), r.count_if(legal & (phase == p)).alias(f"{p}_balls"))]
    phases = d.groupBy(F.col("batting_team").alias("team"), "format").agg(*parts)
    strength = team_strength(perf, team_bowling(d)).select(*key, "strength")
    return perf.join(records, key).join(phases, key, "left").join(strength, key)


def edition_summary(d: DataFrame) -> DataFrame:
    """Matches, teams, venues, runs, wickets, the highest innings and the mean of first innings of each competition and season."""
    inn = d.groupBy("match_id", "venue", "competition", "season", "innings_number", F.col("batting_team").alias("team")).agg(r.total("runs_total").alias("runs"), r.count_if(F.col("is_wicket")).alias("wickets"))
    return inn.groupBy("competition", "season").agg(
        F.countDistinct("match_id").alias("matches"), F.countDistinct("team").alias("teams"), F.countDistinct("venue").alias("venues"), r.total("runs").alias("runs"), r.total("wickets").alias("wickets"), F.max("runs").alias("highest"), F.avg(F.when(F.col("innings_number") == 1, F.col("runs"))).alias("avg_first")
    )


def leading(counts: DataFrame, name: str, n: int, into: str) -> DataFrame:
    """One row: the n names with the largest counts (column n), as text."""
    top = counts.orderBy(F.desc("n"), name).limit(n)
    rows = F.array_sort(F.collect_list(F.struct("n", F.col(name).alias("name"))), lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["name"] < b["name"], -1).otherwise(1))
    return top.agg(rows.alias("l")).select(F.array_join(F.transform("l", lambda x: F.concat(x["name"], F.lit(":"), x["n"].cast("string"))), ",").alias(into))

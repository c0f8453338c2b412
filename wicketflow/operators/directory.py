"""What a directory of players, teams, venues and competitions shows, and how it is kept: affiliations, leaders, profiles, missing and stale names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.operators.names import get_or_create, identity_key


def first_of(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; Spark cuts the window to a row a task before it shuffles."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def affiliations(d: DataFrame) -> DataFrame:
    """(player, team, format, balls, last): for whom each player has batted or bowled, how often, and when last."""
    bats = d.select(F.col("batter").alias("player"), F.col("batting_team").alias("team"), "format", "match_date")
    bowls = d.select(F.col("bowler").alias("player"), F.col("bowling_team").alias("team"), "format", "match_date")
    return bats.unionByName(bowls).where("player is not null and team is not null").groupBy("player", "team", "format").agg(F.count("*").alias("balls"), F.max("match_date").alias("last"))


def listed_affiliations(own: DataFrame) -> DataFrame:
    """affiliations() with n: a player's, latest first, then by team and format."""
    place = F.row_number().over(Window.partitionBy("player").orderBy(F.desc("last"), "team", "format"))
    return own.select("player", "team", "format", "last", place.alias("n"))


def display_teams(own: DataFrame, club: tuple[str, ...] = ("T20",)) -> DataFrame:
    """(player, team): the latest club, by the formats that clubs play, else the latest team; more balls, then the name decide."""
    return first_of(own, ["player"], F.when(F.col("format").isin(*club), 0).otherwise(1), F.desc("last"), F.desc("balls"), "team").select("player", "team")


def national_teams(own: DataFrame, club: tuple[str, ...] = ("T20",)) -> DataFrame:
    """(player, team): the team of most formats that clubs don't play; more balls, then the name decide."""
    rest = own.where(~F.col("format").isin(*club)).groupBy("player", "team").agg(F.countDistinct("format").alias("formats"), F.sum("balls").alias("balls"))
    return first_of(rest, ["player"], F.desc("formats"), F.desc("balls"), "team").select("player", "team")


def venue_players(lines: DataFrame, n: int = 5) -> DataFrame:
    """(venue, format, player, runs, n): the n players with most runs at each venue and format; lines: batting_lines()."""
    runs = lines.groupBy("venue", "format", "player").agg(r.total("runs").alias("runs"))
    return runs.withColumn("n", F.row_number().over(Window.partitionBy("venue", "format").orderBy(F.desc("runs"), "player"))).where(F.col("n") <= n)


def competition_details(matches: DataFrame) -> DataFrame:
    """(competition, seasons): seasons as an array of (season, n), in order; a competition's seasons bound it."""
    by = matches.groupBy("competition", "season").agg(F.count("*").alias("n"))
    return by.groupBy("competition").agg(F.sort_array(F.collect_list(F.struct("season", "n"))).alias("seasons"))


def leaders(lines: DataFrame, matches: DataFrame, reference: DataFrame) -> DataFrame:
    """(competition, season, player, runs): who made most runs in each season; reference (same columns) stands where it has a row."""
    by = lines.join(matches.select("match_id", "competition", "season"), "match_id").groupBy("competition", "season", "player").agg(r.total("runs").alias("runs"))
    own = first_of(by, ["competition", "season"], F.desc("runs"), "player")
    ref = reference.select("competition", "season", F.struct("player", "runs").alias("_ref"))
    best = F.coalesce(F.col("_ref"), F.struct("player", "runs"))
    return own.join(ref, ["competition", "season"], "full").select("competition", "season", best["player"].alias("player"), best["runs"].alias("runs"))


def activity(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """(player, format, match_id) for everyone who batted or bowled, once a match."""
    return batting.select("player", "format", "match_id").unionByName(bowling.select(F.col("bowler").alias("player"), "format", "match_id")).dropDuplicates()


def with_summary(rows: DataFrame, strength: DataFrame) -> DataFrame:
    """rows of teams and formats with the stored strength, null where none is stored."""
    return rows.join(strength.select("team", "format", "strength"), ["team", "format"], "left")


def team_profiles(performance: DataFrame, strength: DataFrame) -> DataFrame:
    """(team, matches, wins, strength): over all formats; strength is weighted by the matches of the formats that have one."""
    both = with_summary(performance, strength)
    known = F.when(F.col("strength").isNotNull(), F.col("matches"))
    return both.groupBy("team").agg(r.total("matches").alias("matches"), r.total("wins").alias("wins"), (F.sum(F.col("strength") * known) / F.sum(known)).alias("strength"))


def kept_aggregates(rows: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, stale): rows whose match is still there, and those to be removed; a row without a match is stale."""
    ids = matches.select("match_id").distinct()
    return rows.join(ids, "match_id", "left_semi").select(*rows.columns), rows.join(ids, "match_id", "left_anti").select(*rows.columns)


def card_of_rows(d: DataFrame) -> DataFrame:
    """A batting card straight from delivery rows, which counts wides as balls: the older variant of scorecard_batting()."""
    return d.where("batter is not null").groupBy("match_id", "innings_number", F.col("batter").alias("player")).agg(r.total("runs_batter").alias("runs"), F.count("*").alias("balls"))


def card_coverage(card: DataFrame, matches: DataFrame, most_rate: int = 400) -> DataFrame:
    """One row: matches with a card and matches in all, rows, rows without a player, with figures below 0, with too high a strike rate."""
    fast = (F.col("balls") > 0) & (F.col("runs") * 100 > F.col("balls") * most_rate)
    own = card.agg(F.countDistinct("match_id").alias("matches"), F.count("*").alias("rows"), r.count_if(F.col("player").isNull()).alias("without_player"), r.count_if((F.col("runs") < 0) | (F.col("balls") < 0)).alias("negative"), r.count_if(fast).alias("too_fast"))
    return own.crossJoin(F.broadcast(matches.agg(F.countDistinct("match_id").alias("of_matches"))))  # one row each


def dimension_maps(dimensions: dict[str, DataFrame]) -> DataFrame:
    """(kind, k, id): the names, without case, of several dimensions (id, name) that stand for one id only, in one table."""
    parts = [d.select(F.lit(kind).alias("kind"), identity_key(F.col("name")).alias("k"), F.col("id").cast("string").alias("id")) for kind, d in dimensions.items()]
    every = reduce(DataFrame.unionByName, parts).where("k is not null and id is not null")
    return every.groupBy("kind", "k").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def new_entities(names: DataFrame, maps: DataFrame) -> DataFrame:
    """(kind, name): names (kind, name) that no map of dimension_maps() knows, once each."""
    asked = names.where("name is not null").distinct().withColumn("k", identity_key(F.col("name")))
    return asked.join(maps.select("kind", "k"), ["kind", "k"], "left_anti").select("kind", "name")


def required_players(players: DataFrame, referenced: DataFrame) -> DataFrame:
    """(id, name): the rows to insert so that every name of referenced (name) has one in players (id, name); ids follow the names."""
    return get_or_create(referenced, players, "name").join(players.select("name"), "name", "left_anti").select("id", "name")


def without_aliases(stats: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """stats without rows that stand under an alias (alias, name) of someone else's; compared without case."""
    other = aliases.where(identity_key(F.col("alias")) != identity_key(F.col("name"))).select(identity_key(F.col("alias")).alias("_k")).distinct()
    return stats.withColumn("_k", identity_key(F.col(column))).join(other, "_k", "left_anti").select(*stats.columns)


def looked_up(rows: DataFrame, column: str, dimension: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with id: of the dimension (id, name) by name, else by alias (alias, id); null where neither has it."""
    direct = dimension.groupBy(F.col("name").alias(column)).agg(F.min("id").alias("_own"))
    via = aliases.groupBy(F.col("alias").alias(column)).agg(F.min("id").alias("_via"))
    return rows.join(direct, column, "left").join(via, column, "left").withColumn("id", F.coalesce("_own", "_via")).drop("_own", "_via")


def updated(rows: DataFrame, newer: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """rows with newer's values in columns, where newer has the key and a value; all else stays."""
    new = newer.select(*key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def season_ids(matches: DataFrame, seasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(match_id and season_id of each match, all seasons): by competition and the year of the match; new seasons are added.

    seasons: (id, competition, season). A match without a date or competition has no season.
    """
    dated = matches.select("match_id", "competition", F.year("match_date").cast("string").alias("season"))
    every = get_or_create(dated, seasons, "competition", "season")
    return dated.join(every, ["competition", "season"], "left").select("match_id", F.col("id").alias("season_id")), every

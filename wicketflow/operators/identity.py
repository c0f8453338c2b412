"""Ids across stores: maps from one store's ids to another's by natural keys, aliases, and names of live and reference rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.operators.merges import shared_rank
from wicketflow.operators.names import identity_key, in_stages, meaning, parse_int, repointed, sure_ends

#: Names of formats and kinds of dismissal, and what they are called here; others stay (spaces as underscores).
FORMATS = {"IT20": "T20I", "t20i": "T20I", "odi": "ODI", "test": "Test"}
WICKETS = {"obstructing the field": "obstructing_field"}


def format_name(value: Column) -> Column:
    out = value
    for alias, name in FORMATS.items():
        out = F.when(value == alias, name).otherwise(out)
    return out


def wicket_name(kind: Column) -> Column:
    """Lower case, underscores for spaces; null stays null."""
    low = F.trim(F.lower(kind))
    out = F.replace(low, F.lit(" "), F.lit("_"))
    for alias, name in WICKETS.items():
        out = F.when(low == alias, name).otherwise(out)
    return out


def team_names(rows: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """rows with <column>_name and <column>_short; lookup: (alias, name, short).

    An alias as written goes before one without case; a team that isn't listed keeps its name, its first three letters in capitals.
    """
    exact = lookup.groupBy(F.col("alias").alias(column)).agg(F.min(F.struct("name", "short")).alias("_exact"))
    plain = lookup.groupBy(F.lower("alias").alias("_low")).agg(F.min(F.struct("alias", "name", "short")).alias("_plain"))
    out = rows.withColumn("_low", F.lower(column)).join(exact, column, "left").join(plain, "_low", "left")
    own = F.coalesce("_exact", F.when(F.col("_plain").isNotNull(), F.struct(F.col("_plain.name").alias("name"), F.col("_plain.short").alias("short"))), F.struct(F.col(column).alias("name"), F.upper(F.substring(column, 1, 3)).alias("short")))
    return out.withColumn(f"{column}_name", own["name"]).withColumn(f"{column}_short", own["short"]).drop("_low", "_exact", "_plain")


def display_lists(column: Column, aliases: DataFrame, rows: DataFrame, name: str, into: str) -> DataFrame:
    """rows with into: a comma list of names (column), each replaced by its display name; aliases: (alias, name).

    name: the column that tells rows apart. Order is kept; a null list stays null.
    """
    each = rows.select(name, F.posexplode(F.split(column, r"\s*,\s*")).alias("i", "own"))
    known = aliases.select(identity_key(F.col("alias")).alias("k"), F.col("name").alias("shown")).dropDuplicates(["k"])
    shown = each.withColumn("k", identity_key(F.col("own"))).join(known, "k", "left").groupBy(name).agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("shown", "own").alias("s")))).alias("l"))
    return rows.join(shown.select(name, F.array_join(F.transform("l", lambda x: x["s"]), ", ").alias(into)), name, "left")


def single(rows: DataFrame, key: Column, value: str = "id") -> DataFrame:
    """(k, id) for the keys that stand for one id only."""
    return rows.select(key.alias("k"), F.col(value).alias("id")).where("k is not null and id is not null").groupBy("k").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("k", "id")


def resolver(players: DataFrame, aliases: DataFrame) -> DataFrame:
    """(k, id): names without case that mean one player only. players: (id, name, full_name); aliases: (alias, id), which go first.

    A name of several players is left out, unless an alias of one player says whom it means; so is an alias of several that
    is no player's name.
    """
    names = players.select("id", F.explode(F.array("name", "full_name")).alias("name"))
    own = single(names, identity_key(F.col("name"))).withColumnRenamed("id", "own")
    other = single(aliases, identity_key(F.col("alias"))).withColumnRenamed("id", "other")
    return own.join(other, "k", "full").select("k", F.coalesce("other", "own").alias("id"))


def team_matches(names: DataFrame, teams: DataFrame) -> DataFrame:
    """(name, id): by name as written, short name, name without case, then as part of one team's name only; null where in doubt.

    teams: (id, name, short). The first stage that knows a name decides, also that it's in doubt.
    """
    asked = names.select("name").where("name is not null").distinct().withColumns({"_short": F.col("name"), "_key": identity_key(F.col("name"))})
    stages = [("name", meaning(teams, F.col("name"))), ("_short", meaning(teams, F.col("short"))), ("_key", meaning(teams, identity_key(F.col("name"))))]
    return in_stages(asked, stages, teams.select("id", F.col("name").alias("text")))


def map_ids(source: DataFrame, target: DataFrame, natural: list[str]) -> DataFrame:
    """(id, target_id): the same id where target has it, else the row with the same natural key without case; null where none or several."""
    key = F.concat_ws("|", *[identity_key(F.col(c).cast("string")) for c in natural])
    same = target.select("id", F.col("id").alias("same"))
    by = single(target, key).withColumnRenamed("id", "by_key")
    return source.withColumn("k", key).join(same, "id", "left").join(by, "k", "left").select("id", F.coalesce("same", "by_key").alias("target_id"))


def map_players(source: DataFrame, target: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, target_id): by id, name, full name, alias, any of these; each only where one player is meant. Both: (id, name, full_name)."""
    name, full = identity_key(F.col("name")), identity_key(F.col("full_name"))
    every = target.select("id", F.explode(F.array("name", "full_name")).alias("n")).unionByName(aliases.select("id", F.col("alias").alias("n")))
    out = source.withColumn("kn", name).withColumn("kf", full).join(target.select("id", F.col("id").alias("same")), "id", "left")
    stages = [("kn", single(target, name)), ("kf", single(target, full)), ("kn", single(aliases, identity_key(F.col("alias")))), ("kn", single(every, identity_key(F.col("n")))), ("kf", single(every, identity_key(F.col("n"))))]
    for i, (k, table) in enumerate(stages):
        out = out.join(table.withColumnsRenamed({"k": k, "id": f"s{i}"}), k, "left")
    return out.select("id", F.coalesce("same", *[f"s{i}" for i in range(len(stages))]).alias("target_id"))


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """(alias, id, source): new rows in place of old ones of the same alias, without case."""
    both = old.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    w = Window.partitionBy(identity_key(F.col("alias"))).orderBy("age", "alias", "id")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "age")


def merge_competitions(competitions: DataFrame, seasons: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(competitions, seasons, conflicts): alias competitions folded into where their chain ends; merged: (from_id, to_id).

    Chains that are cycles or forks raise ValueError. Seasons move to the one that stays; two of them with the same name and different dates are a conflict, for the caller to refuse.
    """
    merged = sure_ends(merged)
    stay = competitions.join(merged.select(F.col("from_id").alias("id")), "id", "left_anti")
    moved = repointed(seasons, "competition_id", merged)
    own = moved.groupBy("competition_id", "name").agg(F.min("id").alias("id"), F.min("starts").alias("starts"), F.countDistinct("starts").alias("n"))
    return stay, own.select("id", "competition_id", "name", "starts"), own.where("n > 1").select("competition_id", "name", "n")


def ranking_rows(feed: DataFrame, dimension: DataFrame) -> DataFrame:
    """(id, rank, rating) of a ranking feed (list, at, rank, name, rating as texts): shared ranks filled, numbers read, names matched."""
    rows = shared_rank(feed, "at").join(team_matches(feed.select("name"), dimension), "name", "left")
    return rows.select("id", "rank", parse_int(F.col("rating")).alias("rating"))


def query_terms(query: Column) -> list[Column]:
    """words and season of a search text in lower case: years of four digits, or of two (to 50: 20xx), are the season, the last one counts."""
    tokens = F.filter(F.split(query, " +"), lambda w: w != "")
    year = lambda w: F.when(w.rlike("^(19|20)[0-9]{2}$"), w.try_cast("int")).when(w.rlike("^[0-9]{2}$"), w.try_cast("int") + F.when(w.try_cast("int") <= 50, 2000).otherwise(1900))
    is_year = lambda w: w.rlike("^((19|20)[0-9]{2}|[0-9]{2})$")
    seasons = F.filter(tokens, is_year)
    return [F.array_join(F.filter(tokens, lambda w: ~is_year(w)), " ").alias("words"), year(F.try_element_at(seasons, F.lit(-1))).cast("string").alias("season")]


def score_text(score: Column) -> Column:
    """``187/4 (18.2 ov)`` of (r, w, o); null without runs."""
    return F.when(score["r"].isNotNull(), F.concat(score["r"].cast("string"), F.coalesce(F.concat(F.lit("/"), score["w"].cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), score["o"].cast("string"), F.lit(" ov)")), F.lit(""))))


def two_teams(teams: Column, first: Column, second: Column) -> list[Column]:
    """The two names of an array with at least two, else of the older fields."""
    named = F.filter(F.coalesce(teams, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    whole = F.size(named) >= 2
    return [F.when(whole, F.get(named, F.lit(0))).otherwise(first).alias("team_a"), F.when(whole, F.get(named, F.lit(1))).otherwise(second).alias("team_b")]


def scores_by_team(scores: Column, team_a: Column, team_b: Column) -> list[Column]:
    """Each team's innings as text, joined by ``&``: by the team's name in the innings' name, a first; what is left over fills a team without any."""
    told = F.filter(F.transform(F.coalesce(scores, F.array()), lambda s: F.struct(F.lower(F.coalesce(s["inning"], F.lit(""))).alias("name"), score_text(s).alias("text"))), lambda x: x["text"].isNotNull())
    has = lambda x, t: F.coalesce((t != "") & x["name"].contains(F.lower(t)), F.lit(False))
    text = lambda a: F.transform(a, lambda x: x["text"])
    a = text(F.filter(told, lambda x: has(x, team_a)))
    b = text(F.filter(told, lambda x: ~has(x, team_a) & has(x, team_b)))
    rest = text(F.filter(told, lambda x: ~has(x, team_a) & ~has(x, team_b)))
    fill_a = F.when(F.size(a) > 0, a).otherwise(F.slice(rest, 1, 1))
    fill_b = F.when(F.size(b) > 0, b).otherwise(F.when(F.size(a) > 0, F.slice(rest, 1, 1)).otherwise(F.slice(rest, 2, 1)))
    joined = lambda x: F.nullif(F.array_join(x, " & "), F.lit(""))
    return [joined(fill_a).alias("score_a"), joined(fill_b).alias("score_b")]

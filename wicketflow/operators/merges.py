"""Mergeable partial results, reference overlays, registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.sources.shared import staged


def merge_bowling(chunks: DataFrame) -> DataFrame:
    """Careers of chunks of matches: additive columns summed, best figures the best of all, rates recomputed."""
    best = F.min(F.struct((-F.col("best_wickets")).alias("w"), F.col("best_runs").alias("r")))
    return (
        chunks.groupBy("bowler", "format")
        .agg(*[r.total(c).alias(c) for c in ("matches", "innings", "balls", "conceded", "wickets", "dots")], best.alias("best"))
        .withColumn("best_wickets", -F.col("best.w"))
        .withColumn("best_runs", F.col("best.r"))
        .drop("best")
        .withColumn("economy", r.ratio(F.col("conceded"), F.col("balls"), 6))
    )


def merge_matchups(chunks: DataFrame, least: int = 10) -> DataFrame:
    """chunks: matchups() with least=0 of each chunk."""
    out = chunks.groupBy("batter", "bowler", "format").agg(*[r.total(c).alias(c) for c in ("matches", "balls", "runs", "dismissals", "dots", "boundaries")])
    return out.where(F.col("balls") >= least).withColumn("strike_rate", r.ratio(F.col("runs"), F.col("balls"), 100))


def merge_teams(chunks: DataFrame) -> DataFrame:
    """Sums, and rates weighted by matches."""
    return chunks.groupBy("team", "format").agg(r.total("matches").alias("matches"), r.total("wins").alias("wins"), (F.sum(F.col("avg_score") * F.col("matches")) / F.sum("matches")).alias("avg_score"), F.max("highest").alias("highest"))


def merge_venues(chunks: DataFrame, most: int = 500) -> DataFrame:
    """Sums, match-weighted means, extremes; impossible totals are left out of the highest."""
    return chunks.groupBy("venue", "format").agg(
        r.total("matches").alias("matches"), (F.sum(F.col("avg_first") * F.col("matches")) / F.sum("matches")).alias("avg_first"), F.max(F.when(F.col("highest") <= most, F.col("highest"))).alias("highest"), F.min("lowest").alias("lowest")
    )


def merge_latest(chunks: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the last chunk."""
    rest = [c for c in chunks.columns if c not in key and c != order]
    return chunks.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def overlay(base: DataFrame, reference: DataFrame, key: list[str]) -> DataFrame:
    """reference's values where it has them, base's elsewhere; matches are the larger of both."""
    values = [c for c in base.columns if c not in key]
    ref = reference.select(*key, *[F.col(c).alias(f"_r_{c}") for c in values])
    both = base.join(ref, key, "full")
    return both.select(*key, *[F.greatest(c, f"_r_{c}").alias(c) if c == "matches" else F.coalesce(f"_r_{c}", c).alias(c) for c in values])


def reference_rows(spark_rows: DataFrame, names: list[str]) -> DataFrame:
    """Positional rows (cells: array<string>) as named columns; missing cells are null."""
    return spark_rows.select(*[c for c in spark_rows.columns if c != "cells"], *[F.get("cells", i).alias(n) for i, n in enumerate(names)])


def read_register(spark: SparkSession, people: str, aliases: str) -> DataFrame:
    """(id, name) of people and of their other names, from two CSV files with headers."""
    a = spark.read.csv(people, header=True).select(F.col("identifier").alias("id"), "name")
    b = spark.read.csv(aliases, header=True).select(F.col("identifier").alias("id"), "name")
    return a.unionByName(b).where("id is not null and name is not null").distinct()


def shared_rank(feed: DataFrame, order: str) -> DataFrame:
    """A missing or ``=`` rank takes the one before it within its list, in feed order; null where none comes before.

    Lists are dealt by ranges of (list, order) and filled within each; what a range lacks at its beginning is the last rank of
    the ranges before it, of which there is a row each. So no task holds a whole list. Rows of one place in a list come in any order.
    """
    keys = [F.asc_nulls_first("list"), F.asc_nulls_first(order)]
    dealt = feed.withColumn("_rank", F.col("rank").try_cast("int")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), "feed").withColumn("_range", F.shiftright("_at", 33))
    last = rows.groupBy("list", "_range").agg(F.max_by("_rank", F.when(F.col("_rank").isNotNull(), F.col("_at"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy("list").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(F.col("list").alias("_list"), F.col("_range").alias("_own"), before.alias("_carried"))
    both = rows.join(carried, F.col("list").eqNullSafe(F.col("_list")) & (F.col("_range") == F.col("_own")))
    within = Window.partitionBy("list", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("rank", F.coalesce(F.last("_rank", ignorenulls=True).over(within), "_carried")).select(*feed.columns)


def match_detail(matches: DataFrame, batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """A match with its batting and bowling cards as nested arrays in order; a match's size bounds each array."""
    bat = batting.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("innings_number", "position", "player", "runs", "balls"))).alias("batting"))
    bowl = bowling.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("innings_number", "position", "bowler", "wickets", "conceded"))).alias("bowling"))
    return matches.join(bat, "match_id", "left").join(bowl, "match_id", "left")

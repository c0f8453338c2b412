"""Data quality: audit rules as rows, reconciliations, repairs. Each rule is an aggregate or an anti join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.operators import digests


def counted(table: DataFrame, category: str, checks: dict[str, Column], warnings: tuple[str, ...] = ()) -> DataFrame:
    """(category, check, status, n): rows that break each rule, all rules in one pass over the table; warnings don't fail."""
    one = table.agg(*[r.count_if(c).alias(k) for k, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.lit("WARN" if k in warnings else "FAIL").alias("else_"), F.col(k).alias("n")) for k in checks])
    return one.select(F.inline(rows)).select(F.lit(category).alias("category"), "check", F.when(F.col("n") == 0, "PASS").otherwise(F.col("else_")).alias("status"), "n")


def orphans(table: DataFrame, column: str, dimension: DataFrame, key: str, category: str, check: str) -> DataFrame:
    """Rows whose reference isn't in the dimension."""
    lost = table.where(F.col(column).isNotNull()).select(F.col(column).alias("_k")).join(dimension.select(F.col(key).alias("_k")).distinct(), "_k", "left_anti")
    n = lost.agg(F.count("*").alias("n"))
    return n.select(F.lit(category).alias("category"), F.lit(check).alias("check"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"), "n")


def duplicates(table: DataFrame, key: str, category: str, check: str, status: str = "FAIL") -> DataFrame:
    """Keys that occur more than once."""
    n = table.groupBy(key).agg(F.count("*").alias("c")).agg(r.count_if(F.col("c") > 1).alias("n"))
    return n.select(F.lit(category).alias("category"), F.lit(check).alias("check"), F.when(F.col("n") == 0, "PASS").otherwise(status).alias("status"), "n")


def size(table: DataFrame, category: str) -> DataFrame:
    """The number of rows; a table without any fails."""
    n = table.agg(F.count("*").alias("n"))
    return n.select(F.lit(category).alias("category"), F.lit("total").alias("check"), F.when(F.col("n") > 0, "PASS").otherwise("FAIL").alias("status"), "n")


def audit_dimension(table: DataFrame, category: str, *, status: str = "FAIL", brackets: bool = True, aliases: DataFrame | None = None) -> DataFrame:
    """Names that differ by case only, names with brackets, aliases of no one, and the number of rows. table: (id, name); aliases: (id)."""
    parts = [duplicates(table.select(F.lower(F.trim("name")).alias("name")), "name", category, "duplicate_name", status)]
    if brackets:
        parts.append(counted(table, category, {"bracketed_name": F.col("name").rlike(r"[()\[\]]")}))
    if aliases is not None:
        parts.append(orphans(aliases, "id", table, "id", category, "orphan_alias"))
    return audit([*parts, size(table, category)])


def audit(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("checks"), r.total("n").alias("rows"))


def audit_deliveries(d: DataFrame, matches: DataFrame) -> DataFrame:
    """Missing players and negative runs fail; balls out of range and wickets of no one warn; totals of each format."""
    checks = {
        "null_batter": F.col("batter").isNull(), "null_bowler": F.col("bowler").isNull(), "negative_runs": (F.col("runs_total") < 0) | (F.col("runs_batter") < 0),
        "ball_out_of_range": (F.col("over_number") < 0) | ~F.col("ball_in_over").between(1, 12), "wicket_without_player": F.col("is_wicket") & F.col("dismissed_player").isNull(),
    }
    totals = d.groupBy("format").agg(F.count("*").alias("n")).select(F.lit("deliveries").alias("category"), F.concat(F.lit("total "), "format").alias("check"), F.lit("PASS").alias("status"), "n")
    return audit([counted(d, "deliveries", checks, ("ball_out_of_range", "wicket_without_player")), orphans(d, "match_id", matches, "match_id", "deliveries", "orphan_match"), totals])


#: The most innings of a match, with those that break ties; formats that aren't listed: 4.
MOST_INNINGS = {"T20": 6, "T20I": 6, "ODI": 4, "Test": 4}


def audit_innings(inn: DataFrame, matches: DataFrame) -> DataFrame:
    """Innings numbers beyond the format's most warn; innings of no match fail. inn: a row an innings."""
    most = F.lit(4)
    for f, limit in MOST_INNINGS.items():
        most = F.when(F.col("format") == f, limit).otherwise(most)
    ranges = inn.groupBy("format").agg(F.max("innings_number").alias("top"), F.count("*").alias("n"))
    rows = ranges.select(F.lit("innings").alias("category"), F.concat(F.lit("range "), "format").alias("check"), F.when(F.col("top") > most, "WARN").otherwise("PASS").alias("status"), "n")
    return audit([rows, orphans(inn, "match_id", matches, "match_id", "innings", "orphan_match")])


def by_format(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, format, n): rows of each table in each format."""
    return reduce(DataFrame.unionByName, [df.groupBy("format").agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "format", "n") for k, df in tables.items()])


def corrected(stored: DataFrame, source: DataFrame, key: list[str], value: str) -> DataFrame:
    """stored with source's values where they differ, and whether that was so; keys that source lacks stay."""
    both = stored.join(source.select(*key, F.col(value).alias("_new")), key, "left")
    return both.select(*key, F.coalesce("_new", value).alias(value), (F.col("_new").isNotNull() & ~F.col(value).eqNullSafe(F.col("_new"))).alias("fixed"))


def audit_matches(matches: DataFrame, d: DataFrame, formats: tuple[str, ...] = ("T20", "T20I", "ODI", "Test")) -> DataFrame:
    checks = {"bad_format": ~F.col("format").isin(*formats), "missing_team": F.col("team_a").isNull() | F.col("team_b").isNull(), "missing_date": F.col("match_date").isNull()}
    return audit([counted(matches, "matches", checks), duplicates(matches, "match_id", "matches", "duplicate_id"), orphans(matches, "match_id", d, "match_id", "matches", "no_innings")])


def card_against_innings(card: DataFrame, totals: DataFrame, factor: float = 1.5) -> DataFrame:
    """Innings whose batting card adds up to more than factor times the innings total."""
    sums = card.groupBy("match_id", "innings_number").agg(r.total("runs").alias("card_runs"))
    return sums.join(totals.select("match_id", "innings_number", "runs"), ["match_id", "innings_number"]).where(F.col("card_runs") > F.col("runs") * factor)


def clamp(rows: DataFrame) -> DataFrame:
    """No negative counts, not-outs within innings, the average from what is left."""
    n, runs = F.greatest("innings", F.lit(0)), F.greatest("runs", F.lit(0))
    no = F.least(F.greatest("not_outs", F.lit(0)), n)
    return rows.withColumn("innings", n).withColumn("runs", runs).withColumn("not_outs", no).withColumn("average", r.ratio(F.col("runs"), F.col("innings") - F.col("not_outs")))


def remap(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with column mapped, rows without a mapping); ids: (old_id, new_id)."""
    m = ids.select(F.col("old_id").alias(column), "new_id")
    both = rows.join(m, column, "left")
    return both.where("new_id is not null").withColumn(column, F.col("new_id")).drop("new_id"), both.where("new_id is null").drop("new_id")


def differing(stored: DataFrame, source: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose stored value differs from the source's."""
    return stored.join(source.select(*key, F.col(value).alias("expected")), key).where(~F.col(value).eqNullSafe(F.col("expected"))).select(*key, value, "expected")


def safe_not_outs(innings: Column, not_outs: Column) -> Column:
    """The sum of not-outs, not below 0 and not above that of innings."""
    return F.least(F.greatest(F.sum(not_outs), F.lit(0)), F.sum(innings)).cast("long")


def synced(stored: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """stored with the rows that it lacks and source's values where they differ; rows that source lacks stay."""
    return stored.join(source.select(*key), key, "left_anti").unionByName(source.select(*stored.columns))


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()])


def compared(source: dict[str, DataFrame], target: dict[str, DataFrame], references: dict[str, tuple[str, str]], keys: dict[str, list[str]]) -> DataFrame:
    """(table, source, target, orphans, differing): rows of both stores, rows of target whose reference (column, table) isn't there,
    and keys whose rows aren't the same in both."""
    parts = []
    for k in source:
        n = table_sizes({k: source[k]}).select(F.col("name").alias("table"), F.col("n").alias("source"))
        there = table_sizes({k: target[k]}).select(F.col("name").alias("table"), F.col("n").alias("target"))
        column, other = references.get(k, (None, None))
        lost = orphans(target[k], column, target[other], column, k, "orphans").select(F.col("category").alias("table"), F.col("n").alias("orphans")) if column else n.select("table", F.lit(0).cast("long").alias("orphans"))
        unlike = digests.differences(source[k], target[k], keys[k]).agg(F.count("*").alias("differing")).withColumn("table", F.lit(k))
        parts.append(n.join(there, "table").join(lost, "table").join(unlike, "table").select("table", "source", "target", "orphans", "differing"))
    return reduce(DataFrame.unionByName, parts)


def expected(category: str, check: str, table: DataFrame, want: Column, have: Column) -> DataFrame:
    """(category, check, expected, actual, status) of two aggregates over a table."""
    one = table.agg(want.cast("long").alias("expected"), have.cast("long").alias("actual"))
    return one.select(F.lit(category).alias("category"), F.lit(check).alias("check"), "expected", "actual", F.when(F.col("expected").eqNullSafe(F.col("actual")), "PASS").otherwise("FAIL").alias("status"))


def sync_checks(
    source: dict[str, DataFrame],
    target: dict[str, DataFrame],
    keys: dict[str, list[str]],
    *,
    links: dict[str, list[str]] | None = None,
    references: dict[str, tuple[str, str]] | None = None,
    covered: dict[str, tuple[str, str]] | None = None,
    golden: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """(category, check, expected, actual, status): what has to hold when source has been brought to target.

    rows and differing: as many rows, and none of other contents, under the keys. links: columns that are filled as often in
    target as in source. references: column -> table whose rows have to be there. covered: a column of which every value of
    the other table's has rows in this one. golden: rows that target has to hold just so, in the columns that they give.
    """
    parts, one = [], lambda n, name: n.agg(F.count("*").alias(name))

    def pair(category: str, check: str, want: DataFrame, have: DataFrame) -> None:
        both = want.crossJoin(F.broadcast(have))  # one row each
        parts.append(expected(category, check, both, F.max("e"), F.max("a")))

    for k in source:
        pair(k, "rows", one(source[k], "e"), one(target[k], "a"))
        none = digests.differences(source[k], target[k], keys[k])
        parts.append(expected(k, "differing", none, F.lit(0), F.count("*")))
        for column in (links or {}).get(k, []):
            pair(k, f"filled {column}", source[k].agg(F.count(column).alias("e")), target[k].agg(F.count(column).alias("a")))
        if k in (references or {}):
            column, other = references[k]
            lost = target[k].where(F.col(column).isNotNull()).join(target[other].select(column).distinct(), column, "left_anti")
            parts.append(expected(k, f"orphans of {other}", lost, F.lit(0), F.count("*")))
        if k in (covered or {}):
            column, other = covered[k]
            pair(k, f"covers {other}", target[other].agg(F.countDistinct(column).alias("e")), target[k].select(column).distinct().join(target[other].select(column).distinct(), column, "left_semi").agg(F.count("*").alias("a")))
        if k in (golden or {}):
            rows, given = golden[k], golden[k].columns
            same = reduce(Column.__and__, [F.col(f"g.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in given])
            met = rows.alias("g").join(target[k].select(*given).distinct().alias("t"), same, "left_semi")
            pair(k, "golden rows", one(rows, "e"), one(met, "a"))
    return reduce(DataFrame.unionByName, parts)

"""Names: canonical forms, alias lookups, unambiguous resolution, merging identities, search text.

Dimension tables are joined, never looped over; what is broadcast is left to Spark's own size check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketflow.operators import grams
from wicketflow.sources.shared import staged

#: Words that an acronym leaves out.
STOP_WORDS = ("of", "the", "and", "a", "an", "for", "in")
ACCENTED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def identity_key(name: Column) -> Column:
    """Lower case, single spaces, trimmed; null stays null."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def search_text(value: Column) -> Column:
    """Lower case without accents; letters and digits parted; all else a space."""
    s = F.translate(F.lower(F.coalesce(value, F.lit(""))), ACCENTED, PLAIN)
    s = F.regexp_replace(F.regexp_replace(s, r"([a-z])([0-9])", "$1 $2"), r"([0-9])([a-z])", "$1 $2")
    return F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " "))


def acronym(name: Column) -> Column:
    """Initials of the words that aren't stop words, repeats included."""
    words = F.filter(F.split(search_text(name), " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def season_sort(label: Column) -> Column:
    """The largest four-digit year in a label, or 0."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.coalesce(label, F.lit("")), F.lit(r"([0-9]{4})")), lambda y: y.cast("int"))), F.lit(0))


def name_parts(name: Column) -> list[Column]:
    """First name, the rest, and initials."""
    parts = F.split(F.trim(name), r"\s+")
    return [F.get(parts, 0).alias("first_name"), F.array_join(F.slice(parts, 2, 99), " ").alias("last_name"), F.array_join(F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1))), "").alias("initials")]


def overs_to_balls(overs: Column, balls_per_over: int = 6) -> Column:
    """``83.1`` -> 499; null for what isn't a number of overs."""
    text = overs.cast("string")
    return F.split_part(text, F.lit("."), F.lit(1)).try_cast("int") * balls_per_over + F.coalesce(F.split_part(text, F.lit("."), F.lit(2)).try_cast("int"), F.lit(0))


def balls_to_overs(balls: Column, balls_per_over: int = 6) -> Column:
    """Cricket notation, as text: 499 -> ``83.1``."""
    return F.concat(F.floor(balls / balls_per_over).cast("string"), F.lit("."), (balls % balls_per_over).cast("string"))


def score_value(text: Column) -> Column:
    """``112*`` -> 112."""
    return F.regexp_replace(F.trim(text), r"\*", "").try_cast("int")


def bowling_figures(text: Column) -> list[Column]:
    """``6/25`` -> 6 and 25."""
    return [F.split_part(text, F.lit("/"), F.lit(1)).try_cast("int").alias("wickets"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("int").alias("runs")]


def parse_int(text: Column) -> Column:
    """Thousands separated by commas."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("int")


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def rank_change(text: Column) -> Column:
    """The first signed whole number in a text."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"([+-]?[0-9]+)", 1).try_cast("int")


def canonical(rows: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """rows with column replaced by its canonical name, looked up without case; aliases: (alias, name), one name an alias."""
    a = aliases.select(identity_key(F.col("alias")).alias("_key"), F.col("name").alias("_name")).dropDuplicates(["_key"])
    out = rows.withColumn("_key", identity_key(F.col(column))).join(a, "_key", "left")
    return out.withColumn(column, F.coalesce("_name", column)).drop("_key", "_name")


def meaning(rows: DataFrame, key: Column, value: str = "id") -> DataFrame:
    """(k, m): how many ids each key stands for, and the smallest; null keys and ids are left out."""
    found = rows.select(key.alias("k"), F.col(value).alias("id")).where("k is not null and id is not null").groupBy("k")
    return found.agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).select("k", F.struct("n", "id").alias("m"))


def in_stages(asked: DataFrame, stages: list[tuple[str, DataFrame]], parts: DataFrame) -> DataFrame:
    """(name, id): the first stage that knows a name decides; where it knows several ids the name is in doubt, and id is null.

    asked: (name) and the columns that stages look up; a stage: (column, meaning()). The last stage takes the names that none
    of them knows as a part of one of parts' texts (id, text), without case, by the index of runs; shorter ones are part of none.
    """
    out = asked.withColumn("_low", identity_key(F.col("name")))
    for i, (column, known) in enumerate(stages):
        out = out.join(known.withColumnsRenamed({"k": column, "m": f"_s{i}"}), column, "left")
    told = F.coalesce(*[f"_s{i}" for i in range(len(stages))])
    held = grams.holders(out.where(told.isNull()).select("_low"), parts.select("id", identity_key(F.col("text")).alias("text")), "_low", "text")
    near = meaning(held, F.col("_low")).withColumnsRenamed({"k": "_low", "m": "_part"})
    m = F.coalesce(told, "_part")
    return out.join(near, "_low", "left").select("name", F.when(m["n"] == 1, m["id"]).alias("id"))


def resolve_unambiguous(names: DataFrame, dimension: DataFrame) -> DataFrame:
    """(name, id): as written, else without case, else as a part of one candidate's name only; null where none or several.

    names: (name), of which null is one; dimension: (id, name).
    """
    asked = names.select("name").distinct().withColumn("_key", identity_key(F.col("name")))
    stages = [("name", meaning(dimension, F.col("name"))), ("_key", meaning(dimension, identity_key(F.col("name"))))]
    return in_stages(asked, stages, dimension.select("id", F.col("name").alias("text")))


def runs_of(rows: DataFrame, size: int) -> DataFrame:
    """rows with g: each run of so many letters of text, once a row: an index for parts of texts."""
    at = F.sequence(F.lit(1), F.length("text") - size + 1)
    return rows.where(F.length("text") >= size).select("*", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("text"), i, F.lit(size))))).alias("g"))


def initial_pairs(names: DataFrame) -> DataFrame:
    """(short, long): names of one surname whose first names are an initial and a word that begins with it. names: (name)."""
    parts = names.select("name", F.split(identity_key(F.col("name")), " ").alias("w")).where(F.size("w") >= 2).select("name", F.try_element_at("w", F.lit(-1)).alias("surname"), F.get("w", 0).alias("first"))
    parts = parts.withColumn("letter", F.substring("first", 1, 1)).withColumn("bare", F.regexp_replace("first", "[0-9.]", ""))
    short = parts.where(F.length("bare") == 1).select("surname", "letter", F.col("name").alias("short"))
    long = parts.where(F.length("bare") > 1).select("surname", "letter", F.col("name").alias("long"))
    return short.join(long, ["surname", "letter"]).select("short", "long")


def duplicate_names(dimension: DataFrame) -> DataFrame:
    """Ids whose names agree but for case and spaces, a row a name: grouped, so no pair is made."""
    return dimension.groupBy(identity_key(F.col("name")).alias("key")).agg(F.sort_array(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def get_or_create(names: DataFrame, existing: DataFrame, *natural: str) -> DataFrame:
    """existing with a row for each new natural key; ids are hashes of the key, so reruns give the same."""
    new = names.select(*natural).where(" and ".join(f"{c} is not null" for c in natural)).distinct().join(existing, list(natural), "left_anti")
    made = new.select(F.sha2(F.concat_ws("|", *natural), 256).alias("id"), *natural)
    return existing.select("id", *natural).unionByName(made)


def chain_ends(merged: DataFrame) -> DataFrame:
    """(from_id, to_id, hops, refused): where each chain of merges (from_id, to_id) ends, by pointer jumping.

    In each round every pointer takes over its target's pointer, so a chain of n merges takes log2(n) rounds; each is written,
    so that lost executors cost a read. refused: ``fork`` for an id that is merged into several, whose chains end there, and
    ``cycle`` for ids whose chain never ends; to_id and hops are null for both. Merges of an id into itself, and nulls, are none.
    """
    links = merged.select("from_id", "to_id").where("from_id <> to_id").distinct()
    counted = staged(links.groupBy("from_id").agg(F.count("*").alias("n"), F.min("to_id").alias("to_id")), "merges")
    pointers = staged(counted.where("n = 1").select("from_id", "to_id", F.lit(1).cast("long").alias("hops")), "pointers")
    rounds = max(pointers.count() - 1, 0).bit_length() + 1
    for _ in range(rounds):
        ahead = pointers.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next"), F.col("hops").alias("more"))
        pointers = staged(pointers.join(ahead, "to_id", "left").select("from_id", F.coalesce("next", "to_id").alias("to_id"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("open")), "pointers")
        if pointers.where("open").isEmpty():
            break
        pointers = pointers.drop("open")
    # what still points to a pointer after so many rounds goes round in a cycle
    loops = pointers.join(pointers.select(F.col("from_id").alias("to_id")), "to_id", "left_semi").select("from_id").withColumn("loop", F.lit(True))
    ends = pointers.select("from_id", "to_id", "hops").join(loops, "from_id", "left")
    done = ends.select("from_id", *[F.when(F.col("loop").isNull(), F.col(c)).alias(c) for c in ("to_id", "hops")], F.when(F.col("loop"), "cycle").alias("refused"))
    forks = counted.where("n > 1").select("from_id", F.lit(None).cast(merged.schema["to_id"].dataType).alias("to_id"), F.lit(None).cast("long").alias("hops"), F.lit("fork").alias("refused"))
    return done.unionByName(forks)


def sure_ends(merged: DataFrame) -> DataFrame:
    """(from_id, to_id) of chain_ends(); raises ValueError if a merge is refused."""
    ends = staged(chain_ends(merged), "chain_ends")
    if bad := ends.where("refused is not null").orderBy("from_id").take(5):
        raise ValueError("merges without an end: " + ", ".join(f"{x['from_id']} ({x['refused']})" for x in bad))
    return ends.select("from_id", "to_id")


def repointed(table: DataFrame, column: str, ends: DataFrame) -> DataFrame:
    """table with column re-pointed to the ends of chain_ends()."""
    m = ends.where("to_id is not null").select(F.col("from_id").alias(column), F.col("to_id").alias("_to"))
    return table.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def merge_ids(table: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """table with column re-pointed to where the chains of merged (from_id, to_id) end; cycles and forks raise ValueError."""
    return repointed(table, column, sure_ends(merged)).select(*table.columns)


def merge_everywhere(dimension: DataFrame, tables: dict[str, tuple[DataFrame, list[str], list[str]]], merged: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(dimension, tables): merged ids gone from dimension (id, ...), every reference to them re-pointed.

    tables: name -> (table, columns that refer to the dimension, natural key); rows that come to share a natural key are left
    once, the one with the smallest of the other columns (no key: all rows stay). Cycles and forks raise ValueError.
    """
    ends, out = sure_ends(merged), {}
    for name, (table, columns, key) in tables.items():
        moved = table
        for c in columns:
            moved = repointed(moved, c, ends)
        rest = [c for c in table.columns if c not in key]
        if key:
            moved = moved.groupBy(*key).agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("r")).select(*key, *[f"r.`{c}`" for c in rest])
        out[name] = moved.select(*table.columns)
    return dimension.join(ends.select(F.col("from_id").alias("id")), "id", "left_anti"), out


def alias_or_create(names: DataFrame, existing: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id): by alias without case, else by name, else a new id from the name. existing: (id, name); aliases: (alias, id)."""
    known = aliases.select(identity_key(F.col("alias")).alias("_k"), F.col("id").alias("_alias")).dropDuplicates(["_k"])
    own = existing.select("name", F.col("id").alias("_own"))
    out = names.select("name").where("name is not null").distinct().withColumn("_k", identity_key(F.col("name"))).join(known, "_k", "left").join(own, "name", "left")
    return out.select("name", F.coalesce("_alias", "_own", F.sha2("name", 256)).alias("id"))


def entities(d: DataFrame, bowls: int = 30) -> DataFrame:
    """(kind, name, role, first_team) of all players, teams and venues: bowlers have bowled so many balls; the team of the first match."""
    pos = F.concat(F.col("match_date").cast("string"), "match_id")
    both = d.select(F.col("batter").alias("name"), F.lit(0).alias("bowled"), F.col("batting_team").alias("team"), pos.alias("pos")).unionByName(d.select(F.col("bowler").alias("name"), F.lit(1).alias("bowled"), F.col("bowling_team").alias("team"), pos.alias("pos")))
    players = both.groupBy("name").agg(F.when(F.sum("bowled") >= bowls, "bowler").otherwise("batter").alias("role"), F.min_by("team", "pos").alias("first_team"))
    rest = [d.select(F.lit(k).alias("kind"), F.col(c).alias("name"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("first_team")).distinct() for k, c in (("team", "batting_team"), ("venue", "venue"))]
    return reduce(DataFrame.unionByName, [players.select(F.lit("player").alias("kind"), "name", "role", "first_team"), *rest])


def search(editions: DataFrame, queries: DataFrame, aliases: DataFrame | None = None, n: int = 5) -> DataFrame:
    """The n best editions for each query; editions: (id, name, season) and, if known, short and matches; queries: (query), aliases: (alias, name).

    alias 120, name or short name 110, acronym 95, part of the name (four letters or more) 80, all words (two or more) 70; a
    query that names a season finds only its editions, with 25 more. Ties: later seasons, then more matches, then ids.
    Editions are found by keys that each kind of match shares with its query, and then scored; those without matches never.
    """
    from wicketflow.operators.identity import query_terms  # that module uses this one

    q = queries.select("query", *query_terms(search_text(F.col("query")))).withColumnRenamed("season", "year").where("words <> ''")
    if aliases is not None:
        known = aliases.select(search_text(F.col("alias")).alias("words"), search_text(F.col("name")).alias("meant")).dropDuplicates(["words"])
        q = q.join(known, "words", "left")
    else:
        q = q.withColumn("meant", F.lit(None).cast("string"))
    for column, default in (("short", F.lit(None).cast("string")), ("matches", F.lit(1))):
        editions = editions if column in editions.columns else editions.withColumn(column, default)
    e = editions.where("matches > 0").select("id", "name", "season", "matches", search_text(F.col("name")).alias("text"), search_text(F.col("short")).alias("short_text"), acronym(F.col("name")).alias("short"))
    compact = F.regexp_replace("words", " ", "")
    begins = F.substring("words", 1, 4)
    asked = q.select("*", F.explode(F.array(F.concat(F.lit("a:"), compact), F.concat(F.lit("t:"), "words"), F.concat(F.lit("t:"), F.coalesce("meant", F.lit(""))), F.concat(F.lit("w:"), F.get(F.split("words", " "), F.lit(0))), F.concat(F.lit("g:"), begins))).alias("k"))
    own = e.select("id", F.explode(F.concat(F.transform(F.split("text", " "), lambda w: F.concat(F.lit("w:"), w)), F.array(F.concat(F.lit("a:"), "short"), F.concat(F.lit("a:"), F.regexp_replace("short_text", " ", "")), F.concat(F.lit("t:"), "text"), F.concat(F.lit("t:"), "short_text")))).alias("k"))
    hits = asked.join(own.unionByName(runs_of(e, 4).select("id", F.concat(F.lit("g:"), "g").alias("k"))), "k").select("query", "id").distinct()
    both = hits.join(q, "query").join(e, "id").where(F.col("year").isNull() | F.col("season").contains(F.col("year")))
    words = F.split("words", " ")
    base = (
        F.when(F.col("meant") == F.col("text"), 120)
        .when((F.col("text") == F.col("words")) | (F.col("short_text") == F.col("words")), 110)
        .when((F.col("short") == compact) | (F.regexp_replace("short_text", " ", "") == compact), 95)
        .when((F.length("words") >= 4) & F.col("text").contains(F.col("words")), 80)
        .when((F.size(words) >= 2) & F.forall(words, lambda w: F.array_contains(F.split("text", " "), w)), 70)
    )
    score = base + F.when(F.col("year").isNotNull(), 25).otherwise(0)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc(season_sort(F.col("season"))), F.desc("matches"), "id"))
    return both.withColumn("score", score).where("score is not null").withColumn("n", place).where(F.col("n") <= n).select("query", "n", "id", "score")

"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are maximal runs of letters and digits of the lower-cased text. Each fixed mask, laid at every word position, hashes
the words under its ones and ignores the others. Test and training seeds with equal hashes are joined; each hit fixes an
alignment (the difference of the two positions), along which the words of item and document are compared one by one.

A document is contaminated by an item if, on one alignment, at least NEED of some WINDOW successive item words agree;
items under WINDOW words have to agree as a whole, items under SHORT words match nothing. The masks hit every pattern of
WINDOW - NEED substitutions within WINDOW words, so the search misses no such passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketflow.llm.common import free_name, small_side, utf8

#: Word positions that count (1) and that are ignored (0).
MASKS = ("111001011", "1111011", "110100111")
#: The seed of items that are shorter than the longest mask.
SHORT_MASK = "11111"
SPAN, SHORT = max(map(len, MASKS)), len(SHORT_MASK)
WINDOW, NEED = 13, 11
#: Up to so many seeds (about 40 bytes each) the benchmark is broadcast; beyond, Spark joins by a shuffle.
BROADCAST_SEEDS = 500_000


def word_hashes(text: Column) -> Column:
    """The hashes of a text's words in order; none for a null text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(df: DataFrame, hashes: str, masks: dict[int, str]) -> DataFrame:
    """df with at (a word position) and seed, a row for each mask that fits there."""
    n = F.size(hashes)
    shortest = min(map(len, masks.values()))
    at = df.where(n >= shortest).select("*", F.explode(F.sequence(F.lit(0), F.size(hashes) - F.lit(shortest))).alias("at"))
    each = [
        F.when(F.col("at") + F.lit(len(m)) <= n, F.xxhash64(F.lit(k), *[F.get(hashes, F.col("at") + F.lit(i)) for i, one in enumerate(m) if one == "1"]))
        for k, m in masks.items()
    ]
    return at.select("*", F.explode(F.array(*each)).alias("seed")).where(F.col("seed").isNotNull())


def find_overlaps(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row (doc_id, text_hash, item_id, matched) for each document text and benchmark item that overlap.

    matched: the most agreeing words in a window. Null and empty texts and items overlap with nothing; rows of docs that
    repeat id and text give one row; columns other than id and text are not read.
    """
    items = (
        benchmark.select(F.col(f"`{item_id}`").alias("item_id"), word_hashes(F.col(f"`{text}`")).alias("item"))
        .where(F.size("item") >= SHORT)
        .distinct()
        .withColumn("item_key", F.xxhash64("item_id", "item"))
    )
    masks = dict(enumerate(MASKS))
    test = seeds(items.where(F.size("item") >= SPAN), "item", masks)
    counts = items.agg(F.count(F.when(F.size("item") < SPAN, 1)).alias("short"), F.coalesce(F.sum(F.size("item")), F.lit(0)).alias("words")).first()
    if counts["short"]:
        masks[len(masks)] = SHORT_MASK
        test = test.unionByName(seeds(items.where(F.size("item") < SPAN), "item", {len(MASKS): SHORT_MASK}))
    test = test.select("seed", "item_key", F.col("at").alias("item_at"), F.size("item").alias("item_n"))
    if counts["words"] * len(masks) <= BROADCAST_SEEDS:
        test = F.broadcast(test)
    t = F.col(f"`{text}`")
    train = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(utf8(t)).alias("text_hash"), word_hashes(t).alias("words"))
    shift = F.col("at") - F.col("item_at")
    hits = (
        seeds(train, "words", masks)
        .join(test, "seed")
        .select("doc_id", "text_hash", "item_key", shift.alias("shift"), F.slice("words", F.greatest(shift, F.lit(0)) + 1, F.col("item_n")).alias("words"))
        .dropDuplicates(["doc_id", "text_hash", "item_key", "shift"])
        .join(items, "item_key")
    )
    n = F.size("item")
    agree = F.transform("item", lambda w, j: F.when(w == F.get("words", j + F.least(F.col("shift"), F.lit(0))), 1).otherwise(0))
    within = F.transform(F.sequence(F.lit(1), n), lambda j: F.aggregate(F.slice("agree", j, F.lit(WINDOW)), F.lit(0), lambda a, b: a + b))
    return (
        hits.withColumn("agree", agree)
        .withColumn("matched", F.array_max(within))
        .where(F.col("matched") >= F.when(n >= WINDOW, F.lit(NEED)).otherwise(n))
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(F.max("matched").alias("matched"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of docs that overlap with no item of benchmark, all columns as they are, whatever their names."""
    own_id, own_hash = free_name(docs, "_bad_id"), free_name(docs, "_bad_hash")
    bad = find_overlaps(docs, benchmark, doc_id=doc_id, item_id=item_id, text=text).select("doc_id", "text_hash").distinct()
    bad = small_side(bad.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)), "contaminated")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(utf8(F.col(f"`{text}`"))) == F.col(own_hash))
    return docs.join(bad, same, "left_anti")

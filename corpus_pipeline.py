"""From raw documents to token ids: language, near duplicates, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicketflow.llm import bpe, decontamination, language_id, near_dedup, pii
from wicketflow.llm.common import Scratch, drop_staged, free_name, staged, table

#: A text is rejected if its language can't be told at all or is less probable than this.
LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_used: list[Scratch] = []


def one_at_a_time(stage: Stage) -> Stage:
    """stage, which first gives up what the stage before staged and sent to the executors: its result has been written, docs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _used:
            _used.pop().drop(spark, docs)
        with Scratch() as scratch:
            _used.append(scratch)
            return stage(spark, docs, sf_dir)

    return run_stage


@one_at_a_time
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; lang stays as it came. Texts that are null or have no letter go."""
    model = language_id.train(docs, language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    told = language_id.identify(docs, model, into=lang, score=score)
    return told.where((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


@one_at_a_time
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.deduplicate(docs)


@one_at_a_time
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@one_at_a_time
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


@one_at_a_time
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids."""
    vocab = bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.encode(docs, vocab).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", keep_known_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("encode", encode_texts),
]

#: The language model and the random field are trained, which SQL can't express: tests/llm compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has staged is removed when the next one's input is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        drop_staged(spark, docs)
    return docs

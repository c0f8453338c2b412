"""An index of runs of letters in order of frequency: which texts hold a given part.

A part is looked up by the rarest of its runs, at the distance that the run has from the part's beginning, and compared with
the text there in the same join. What a part costs is the number of texts that hold its rarest run, not its first one; a part
with a run that no text holds costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a run.
SIZE = 3


def runs(rows: DataFrame, text: str, size: int = SIZE) -> DataFrame:
    """rows with at and run: each run of so many letters of text, with the place (from 0) where it begins."""
    places = F.sequence(F.lit(0), F.length(text) - size)
    return rows.where(F.length(text) >= size).select("*", F.posexplode(F.transform(places, lambda i: F.substring(F.col(text), i + 1, F.lit(size)))).alias("at", "run"))


def rarest(parts: DataFrame, postings: DataFrame, part: str, size: int = SIZE) -> DataFrame:
    """(part, run, off, n): each part's run that fewest rows of postings (runs()) have; parts with a run that none has are gone."""
    own = runs(parts.select(part).distinct(), part, size).select(part, "run", F.col("at").alias("off"))
    counts = postings.groupBy("run").agg(F.count("*").alias("n"))
    least = own.join(counts, "run", "left").groupBy(part).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run", "off")).alias("r"))
    return least.where("r.n > 0").select(part, "r.run", "r.off", "r.n")


def holders(parts: DataFrame, texts: DataFrame, part: str, text: str, size: int = SIZE) -> DataFrame:
    """parts' column and texts' columns: a row for each part and each row of texts that holds it.

    Parts that are null or shorter than a run are held by none, here. A text that holds a part twice comes once.
    """
    postings = runs(texts.withColumn("_row", F.struct(*texts.columns)).select("_row", F.col(text).alias("_text")), "_text", size)
    wanted = rarest(parts, postings, part, size).select(F.col(part).alias("_part"), "run", "off")
    there: Column = F.substring(F.col("_text"), F.col("at") - F.col("off") + 1, F.length("_part"))
    found = postings.join(wanted, (postings["run"] == wanted["run"]) & (F.col("at") >= F.col("off")) & (there == F.col("_part")))
    return found.select(F.col("_part").alias(part), "_row").distinct().select(part, "_row.*")

r"""Fill-in-middle transformation by one regular expression with counted quantifiers a row.

A text of n units is matched once by a pattern made for the row: ``a`` units taken possessively are the prefix, ``b - a``
more the middle, the rest the suffix; the replacement puts the three in the form's order. Possessive groups don't
backtrack and are matched in a loop rather than by recursion, so texts of any length pass. All of it is DataFrame
functions: no shuffle, no Python worker, and a row depends on nothing but its key and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketflow.llm.common import refuse_taken

#: A unit is a word with the white space before it, or white space at the end; the marks of the three parts.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The same units with possessive quantifiers: what a unit takes is never given back.
_TAKEN = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
_MARK = "<[PSM]>"


def draws(key: Column, seed: int = 42) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``<seed>:<key>``; a null key is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, key: str, text: str = "text", *, seed: int = 42, rate: int = 50, spm: int = 80, units: str = "n", form: str = "form", output: str = "output") -> DataFrame:
    """df with units (how many the text has), form (plain, psm or spm) and output (the rearranged text).

    rate: of 100 texts so many are rearranged, and of 100 of those so many with the suffix first (spm). The cuts are drawn
    with the key and the seed, anywhere from before the first unit to after the last, so that each part may be empty.

    Plain, with the text as output: empty texts, texts that hold one of the marks, and those not drawn. A null text counts
    as empty and has output ''. Rows with equal key and text give equal results. Other columns stay as they are; raises
    ValueError if df has one of the new names, in whatever case.
    """
    refuse_taken(df, units, form, output)
    names = [F.col(f"`{c}`") for c in df.columns]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counted = df.select(*names, F.regexp_count(whole, F.lit(UNIT)).cast("long").alias(units))
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    stays = (whole == "") | F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE)) | (h3 % 100 >= rate)
    drawn = counted.select(*names, units, F.when(stays, "plain").when(h4 % 100 < spm, "spm").otherwise("psm").alias(form))
    places = F.col(f"`{units}`") + 1
    first, last = F.least(h1 % places, h2 % places), F.greatest(h1 % places, h2 % places)
    pattern = F.concat(F.lit(rf"(?s)\A((?:{_TAKEN}){{"), first, F.lit(rf"}}+)((?:{_TAKEN}){{"), last - first, F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col(f"`{form}`") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    return drawn.select("*", F.when(F.col(f"`{form}`") == "plain", whole).otherwise(F.regexp_replace(whole, pattern, order)).alias(output))


def _part(output: Column, k: int) -> Column:
    return F.get(F.split(output, _MARK), F.lit(k))


def prefix(output: Column, form: Column) -> Column:
    """The prefix in an output; null for the plain form."""
    return F.when(form == "psm", _part(output, 1)).when(form == "spm", _part(output, 2))


def middle(output: Column, form: Column) -> Column:
    """The middle in an output; null for the plain form."""
    return F.when(form != "plain", _part(output, 3))


def restore(output: Column, form: Column) -> Column:
    """The text that output was made from (a null text comes back empty)."""
    return F.when(form == "plain", output).when(form == "psm", F.concat(*(_part(output, k) for k in (1, 3, 2)))).otherwise(F.concat(*(_part(output, k) for k in (2, 3, 1))))

"""Tables that refer to one another, walked in the order of their references: parents first to remap, and to purge.

References are a graph over tables; each level is one join a reference with what its parent kept. Rows that lose a parent are
kept apart with the reason, so that what happens to them at the next level is seen there, too.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """column of table holds the id of a row of parent. required: a row can't be without it; else it is emptied when that goes."""

    table: str
    column: str
    parent: str
    required: bool = True


def in_order(tables: list[str], references: list[Reference]) -> list[str]:
    """tables with parents before what refers to them, otherwise as they come; references that go round raise ValueError.

    A table that refers to itself counts as going round; references to tables that aren't given are for the caller to resolve.
    """
    left, done = list(tables), []
    while left:
        free = [t for t in left if not any(r.table == t and r.parent in left for r in references)]
        if not free:
            raise ValueError(f"references go round among {', '.join(left)}")
        done += free
        left = [t for t in left if t not in free]
    return done


def remapped(
    tables: dict[str, DataFrame], references: list[Reference], ids: dict[str, DataFrame], key: str = "id"
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables, rejects): every table with its key and its references brought to another store's ids.

    ids: table -> (old_id, new_id), one new_id an old_id; a table that isn't listed keeps its key, a row without a new one is
    rejected. Rows whose required reference has no row left are rejected with the reason ``no <parent>: <column>``, and so are
    the rows that refer to them; other references are emptied. A reference that is null stays so, if it isn't required. Tables
    whose parent isn't among tables go by the parent's ids alone.
    """
    out: dict[str, DataFrame] = {}
    rejects: dict[str, DataFrame] = {}
    kept: dict[str, DataFrame] = {k: m.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new")) for k, m in ids.items() if k not in tables}
    for name in in_order(list(tables), references):
        columns, own = tables[name].columns, [r for r in references if r.table == name]
        rows, reasons, new = tables[name], [], {}
        if name in ids:
            rows = rows.join(ids[name].select(F.col("old_id").alias(key), F.col("new_id").alias("_own")), key, "left")
            reasons.append(F.when(F.col("_own").isNull(), "no id"))
            new[key] = "_own"
        for k, ref in enumerate(own):
            rows = rows.join(kept[ref.parent].withColumnsRenamed({"_old": ref.column, "_new": f"_p{k}"}), ref.column, "left")
            new[ref.column] = f"_p{k}"
            if ref.required:
                reasons.append(F.when(F.col(f"_p{k}").isNull(), F.lit(f"no {ref.parent}: {ref.column}")))
        rows = rows.withColumn("_reason", F.coalesce(*reasons) if reasons else F.lit(None).cast("string"))
        good = rows.where("_reason IS NULL")
        out[name] = good.select(*[F.col(new.get(c, c)).alias(c) for c in columns])
        rejects[name] = rows.where("_reason IS NOT NULL").select(*columns, F.col("_reason").alias("reason"))
        if key in columns:
            kept[name] = good.select(F.col(key).alias("_old"), F.col(new.get(key, key)).alias("_new"))
    return out, rejects


def purged(tables: dict[str, DataFrame], references: list[Reference], gone: dict[str, DataFrame], key: str = "id") -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables, purged rows): without the rows of gone (table -> ids, a column called as the key), and without what refers to them.

    Rows whose required reference goes, go too, at every level; other references to them are emptied. The purged rows have a
    level: 0 for those of gone, else one more than the lowest level of the rows that they lose. References to rows that were
    never there stay as they are.
    """
    out: dict[str, DataFrame] = {}
    lost: dict[str, DataFrame] = {}
    for name in in_order(list(tables), references):
        rows, levels = tables[name], []
        if name in gone:
            rows = rows.join(gone[name].select(key).distinct().withColumn("_g", F.lit(0)), key, "left")
            levels.append(F.col("_g"))
        for k, ref in enumerate(r for r in references if r.table == name and r.parent in lost and key in lost[r.parent].columns):
            parent = lost[ref.parent].groupBy(F.col(key).alias(ref.column)).agg(F.min(F.col("level")).alias(f"_l{k}"))
            rows = rows.join(parent, ref.column, "left")
            if ref.required:
                levels.append(F.col(f"_l{k}") + 1)
            else:
                rows = rows.withColumn(ref.column, F.when(F.col(f"_l{k}").isNull(), F.col(ref.column)))
        level = (F.least(*levels) if len(levels) > 1 else levels[0]) if levels else F.lit(None).cast("int")
        rows = rows.withColumn("_level", level)
        columns = tables[name].columns
        out[name] = rows.where("_level IS NULL").select(*columns)
        lost[name] = rows.where("_level IS NOT NULL").select(*columns, F.col("_level").alias("level"))
    return out, lost


def with_ids(rows: DataFrame, names: dict[str, tuple[DataFrame, bool]]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): <column>_id for each of names (column -> (dimension of (name, id), required)), by name.

    A name that is required and missing or unknown rejects its row, with the first such column as the reason; others are null.
    """
    reasons = []
    for column, (dimension, required) in names.items():
        rows = rows.join(dimension.select(F.col("name").alias(column), F.col("id").alias(f"{column}_id")), column, "left")
        if required:
            reasons.append(F.when(F.col(f"{column}_id").isNull(), F.lit(column)))
    told = rows.withColumn("reason", F.coalesce(*reasons) if reasons else F.lit(None).cast("string"))
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def win_type(innings: Column, runs: Column, wickets: Column) -> Column:
    """What a match was won by: an innings before runs before wickets; null if by none of them."""
    return F.when(innings.isNotNull() & (innings != 0), "innings").when(runs.isNotNull() & (runs != 0), "runs").when(wickets.isNotNull() & (wickets != 0), "wickets")


def total(tables: dict[str, DataFrame], *columns: str) -> DataFrame:
    """(table, columns, n): rows of each table, of each value of columns."""
    return reduce(DataFrame.unionByName, [df.groupBy(*columns).agg(F.count("*").alias("n")).select(F.lit(k).alias("table"), *columns, "n") for k, df in tables.items()])

"""Scoring rules as column expressions. Each takes column names from the delivery schema and is used by every aggregate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dismissals that are not the bowler's, and those that are no dismissal.
NOT_BOWLERS = ("run out", "retired hurt", "retired out", "retired not out", "obstructing the field", "handled the ball", "hit the ball twice", "timed out")
NOT_OUT = ("retired hurt", "retired not out")
#: Last over (from 0) of the power play and of the middle overs; formats that aren't listed go by T20.
PHASES = {"T20": (5, 14), "T20I": (5, 14), "ODI": (9, 39)}
MULTI_DAY = ("Test",)


def kind(column: str = "wicket_type") -> Column:
    """A dismissal's kind in lower case, with spaces for underscores."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "_", " ")))


def extra() -> Column:
    return F.lower(F.coalesce(F.col("extra_type"), F.lit("")))


def ball_faced() -> Column:
    """All but wides; a no-ball is faced."""
    return extra() != "wide"


def legal_ball() -> Column:
    return ~extra().isin("wide", "wides", "noball", "no ball", "noballs")


def bowler_runs() -> Column:
    """Runs off the bat, wides and no-balls; byes, leg byes and penalties aren't the bowler's."""
    return F.col("runs_batter") + F.coalesce("extras_wides", F.lit(0)) + F.coalesce("extras_noballs", F.lit(0))


def bowler_wicket() -> Column:
    return F.coalesce(F.col("is_wicket"), F.lit(False)) & ~kind().isin(*NOT_BOWLERS)


def batter_out() -> Column:
    return F.coalesce(F.col("is_wicket"), F.lit(False)) & ~kind().isin(*NOT_OUT)


def boundary(runs: int) -> Column:
    """A real four or six off the bat, not one that was all run."""
    return (F.col("runs_batter") == runs) & ~F.coalesce(F.col("non_boundary"), F.lit(False))


def phase(format_col: str = "format", over: str = "over_number") -> Column:
    """power play, middle or death by format; multi-day formats have only ``general``."""
    f, n = F.col(format_col), F.col(over)
    out = F.when(f.isin(*MULTI_DAY), "general")
    for name, (first, second) in PHASES.items():
        out = out.when((f == name) & (n <= first), "powerplay").when((f == name) & (n <= second), "middle").when(f == name, "death")
    first, second = PHASES["T20"]
    return out.when(n <= first, "powerplay").when(n <= second, "middle").otherwise("death")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(part: Column, whole: Column, times: float = 1.0) -> Column:
    """part / whole * times as double, null where whole is 0."""
    return F.when(whole > 0, part.cast("double") * F.lit(float(times)) / whole)


def total(column: str | Column) -> Column:
    return F.sum(column).cast("long")

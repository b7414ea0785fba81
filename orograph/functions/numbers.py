"""Column helpers for finite numbers, rounding and folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite_or(c: Column, default: float | None) -> Column:
    """The number, or ``default`` where it is null, NaN or infinite."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == INF)
    return F.when(bad, F.lit(default).cast("double")).otherwise(c)


def rounded(c: Column, places: int = 6) -> Column:
    """Half up, by floor: the same in every engine, other than round()."""
    return F.floor(c * float(10**places) + 0.5) / float(10**places)


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.least(F.greatest(c, low), high)


def at_least(c: Column, low: float) -> Column:
    return F.greatest(c, F.lit(float(low)))


def floor_mod(c: Column, m: float) -> Column:
    """Modulo with the sign of the divisor."""
    return ((c % m) + m) % m

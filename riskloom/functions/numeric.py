"""Numeric helpers that fix the differences between NULL, NaN and text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.schema import MISSING_TOKENS


def known(c: Column) -> Column:
    """NaN becomes NULL, so that one missing marker is left and comparisons behave."""
    return F.nanvl(c, F.lit(None).cast("double"))


def is_missing_text(c: Column) -> Column:
    return c.isNull() | F.trim(c).isin(MISSING_TOKENS)


def number_from_text(c: Column) -> Column:
    """Double from text; a missing token or an unparsable one gives NULL."""
    return F.when(~is_missing_text(c), known(F.trim(c).try_cast("double")))


def is_unparsable_text(c: Column) -> Column:
    return ~is_missing_text(c) & F.trim(c).try_cast("double").isNull()


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` alone would return the bound)."""
    out = c
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def whole(c: Column) -> Column:
    """Truncate toward zero."""
    return c.cast("long").cast("double")


def ratio(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """Division that gives ``default`` where the denominator is zero (ANSI division raises)."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(default))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between two zone-free timestamps, whatever the session time zone is."""
    return (later - earlier).cast("interval second").cast("decimal(18,6)").cast("double")

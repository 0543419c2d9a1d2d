"""Number semantics of lenient feeds as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round half toward plus infinity, as a long."""
    return F.floor(x + F.lit(0.5)).cast("long")


def places(x: Column, digits: int) -> Column:
    """Round half toward plus infinity to some decimal places."""
    k = float(10**digits)
    return F.floor(x * F.lit(k) + F.lit(0.5)) / F.lit(k)


def lenient(x: Column) -> Column:
    """Text to double: empty is 0, anything that isn't a number is NaN, null stays null."""
    text = F.trim(x)
    return F.when(text == "", F.lit(0.0)).otherwise(F.coalesce(text.try_cast("double"), F.when(x.isNotNull(), F.lit(float("nan")))))


def or_else(x: Column, other) -> Column:
    """``x`` unless it is null, zero, NaN or empty."""
    text = x.cast("string")
    return F.when(x.isNull() | text.isin("", "0", "0.0", "-0.0", "NaN", "false"),
        F.lit(other) if not isinstance(other, Column) else other).otherwise(x)


def clamp(x: Column, low, high) -> Column:
    """``x`` within its bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def hex_prefix(x: Column) -> Column:
    """The number that a text's leading hex digits spell, null where there are none."""
    digits = F.regexp_extract(F.lower(F.trim(x)), "^(?:0x)?([0-9a-f]{1,15})", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def population_cv(values: Column) -> Column:
    """Population standard deviation over mean of an array; null if empty or the mean is zero."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return F.when((n > 0) & (mean != 0), F.sqrt(var) / mean)

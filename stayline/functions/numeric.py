"""Numeric helpers: half-even rounding, lenient coercion, clipping, scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """A text's number; text that is none, and NaN, gives null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Half-even rounding of the decimal notation (0.125 to 0.12), as SQL does it, not of the binary value."""
    return F.bround(c.cast("double"), digits)


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high] and scale to [0, 1]; null where the bounds are equal or unknown."""
    return F.when(high > low, (clip(c, low, high) - low) / (high - low))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def text_of(c: Column) -> Column:
    """A number as text at one decimal, half-even; whole numbers lose their `.0`."""
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string("%.1f", F.bround(c.cast("double"), 1)), r"\.0$", ""))

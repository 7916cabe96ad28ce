"""Time columns: half-even hours, micros, buckets. All for TIMESTAMP_NTZ under a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def from_micros(c: Column) -> Column:
    """The inverse of :func:`micros`, as TIMESTAMP_NTZ."""
    return F.timestamp_micros(c.cast("bigint")).cast("timestamp_ntz")


def hour_index(c: Column | str) -> Column:
    """Hours since 1970, rounded half-even: 00:30 falls in hour 0, 01:30 in hour 2. Integer arithmetic throughout."""
    us = micros(c)
    low = F.floor(us / F.lit(HOUR_US)).cast("bigint")
    rest = us - low * F.lit(HOUR_US)
    half = F.lit(HOUR_US // 2)
    up = (rest > half) | ((rest == half) & (F.pmod(low, F.lit(2)) == 1))
    return low + up.cast("bigint")


def hour_round(c: Column | str) -> Column:
    """A timestamp rounded half-even to the hour."""
    return from_micros(hour_index(c) * F.lit(HOUR_US))


def hour_floor(c: Column | str) -> Column:
    return from_micros(F.floor(micros(c) / F.lit(HOUR_US)).cast("bigint") * F.lit(HOUR_US))


def hour_ceil(c: Column | str) -> Column:
    return from_micros(F.ceil(micros(c) / F.lit(HOUR_US)).cast("bigint") * F.lit(HOUR_US))


def hours_between(a: Column | str, b: Column | str) -> Column:
    """Hours from ``a`` to ``b`` as DOUBLE."""
    return (micros(b) - micros(a)) / F.lit(float(HOUR_US))


def month_index(c: Column | str) -> Column:
    """Months since year 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c) - 1


def month_start(i: Column) -> Column:
    """First instant of the month of :func:`month_index`."""
    return F.make_timestamp_ntz(F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def stamp(c: Column | str) -> Column:
    """Text ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

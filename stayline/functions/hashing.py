"""Hash-seeded uniform numbers: the same on every run, executor and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of the key's MD5."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def uniform_sql(key: str) -> str:
    """The same number as SQL of the checking engine."""
    return f"((('0x' || substr(md5({key}), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)"

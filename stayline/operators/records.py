"""Samples of stays: the description as of an hour, the change log of the next, and the state that a change log leads to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.numeric import text_of
from stayline.functions.time import hour_index
from stayline.operators import encode as E
from stayline.operators.snapshot import until


def describe(readings: DataFrame, points: DataFrame, keys: Sequence[str], label: str, trailing_hours: int | None = 24, keep: int = 5, root: Sequence[str] = ("ICU Stay", "Chart Events")) -> DataFrame:
    """Facts ``keys, t, path, value`` of what is known at each time point: per label its values as run-length text.

    ``readings`` has ``hour, charttime, v`` (number) and ``value`` (text), ``points`` has ``t``. Numbers of an hour are averaged; an hour
    without numbers has its last text. Nothing dated after ``t`` gets in; points without any reading give no rows.
    """
    k = [*keys, "t", label]
    # an hour's value is the same at whatever point it is seen, so it is worked out before hours meet points
    h = readings.groupBy(*keys, label, "hour").agg(F.avg("v").alias("m"), F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("charttime", "value"))).alias("x"))
    h = h.select(*keys, label, "hour", F.coalesce(text_of(F.round("m", 6)), "x").alias("s")).where("s IS NOT NULL")
    h = until(h, points, keys, "hour", trailing_hours=trailing_hours)
    if trailing_hours is None:
        h = h.select(*k, hour_index("hour").alias("h"), hour_index("t").alias("now"), "s")
        runs = E.run_text(E.value_runs(h, [*k, "now"], "h", "s", tail=keep), [*k, "now"], F.col("now"))
    else:  # at most one entry an hour
        g = h.groupBy(*k).agg(F.collect_list(F.struct(hour_index("hour").alias("h"), "s")).alias("e"))
        runs = g.select(*k, E.run_text_of(F.col("e"), hour_index("t"), keep).alias("values"))
    return runs.select(*keys, "t", F.array(*[F.lit(r) for r in root], F.col(label).cast("string")).alias("path"), F.col("values").alias("value"))


def change_log(readings: DataFrame, points: DataFrame, keys: Sequence[str], label: str, root: Sequence[str] = ("ICU Stay", "Chart Events")) -> DataFrame:
    """Facts ``keys, t, path, value`` of the hour after each time point: the mean of its numbers, else its last text."""
    nxt = readings.withColumn("t", F.col("hour") - F.expr("INTERVAL 1 HOUR"))
    h = points.select(*keys, "t").distinct().join(nxt, [*keys, "t"]).groupBy(*keys, "t", label).agg(F.avg("v").alias("m"), F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("charttime", "value"))).alias("x"))
    return h.select(*keys, "t", F.array(*[F.lit(r) for r in root], F.col(label).cast("string")).alias("path"), F.coalesce(text_of(F.round("m", 6)), "x").alias("value"))


def integrate(readings: DataFrame, facts: DataFrame, keys: Sequence[str], label: str, depth: int = 2) -> DataFrame:
    """Readings with the facts of a change log appended at the hour after their ``t``; the label is the path's part at ``depth``."""
    v = F.col("value").try_cast("double")
    new = facts.select(*keys, F.get("path", F.lit(depth)).cast(dict(readings.dtypes)[label]).alias(label), (F.col("t") + F.expr("INTERVAL 1 HOUR")).alias("hour"), F.nanvl(v, F.lit(None).cast("double")).alias("v"), F.when(v.isNull(), F.col("value")).alias("value"))
    return readings.unionByName(new.withColumn("charttime", F.col("hour")), allowMissingColumns=True)


def samples(described: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per time point: ``keys, t, desc, change`` as arrays of facts in path order; a side without facts is empty."""
    fold = lambda df, name: df.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias(name))
    empty = F.array().cast("array<struct<path:array<string>,value:string>>")
    j = fold(described, "desc").join(fold(changes, "change"), [*keys, "t"], "full_outer")
    return j.withColumns({c: F.coalesce(c, empty) for c in ("desc", "change")})


def visible(df: DataFrame, t: Column, ends: Column, columns: Sequence[str]) -> DataFrame:
    """Facts about a stay's end are nulled until the end has come."""
    return df.withColumns({c: F.when(ends <= t, F.col(c)) for c in columns})

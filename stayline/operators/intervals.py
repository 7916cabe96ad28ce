"""Overlapping, nested and gapped intervals per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.time import micros
from stayline.operators.common import SHARD_ROWS, aside, cut_lineage, hot_shards, require, sharded_neighbours

def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, row_id: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Continuous periods per entity: ``keys, start_at, end_at, n_rows, overlaps, next_start`` (when the entity's next period starts, null after the last).

    Rows lacking a key or a bound, or whose end isn't after their start, are no intervals and are left out. Rows equal
    in keys, bounds and ``row_id`` count once. Touching intervals belong together. ``overlaps`` tells whether two rows
    share more than a point: the rows' lengths then add up to more than the period. An empty input gives no rows.

    A native session window with each row's own length merges an entity's rows; its input is shuffled once, by entity, and what follows stays in that order.
    An entity with over ``shard_rows`` rows and a hundredth of all is cut into stretches of time that are merged apart. Across these only one summary row each is scanned: the furthest end so far
    decides whether a stretch's period goes on from an earlier one, and the last period begun so far says which.
    """
    require(df, [*keys, start, end, row_id])
    keys, hide, show = aside(keys)
    raw = df.select(*hide, F.col(start).alias("s"), F.col(end).alias("e"), F.col(row_id).alias("id")).where(F.col("e") > F.col("s")).dropna(subset=list(keys))
    raw, several = hot_shards(raw, keys, micros("s"), shard_rows)
    rows = raw.repartition(*keys, "__shard").distinct().withColumn("us", micros("e") - micros("s"))
    local = (
        rows.groupBy(*keys, "__shard", F.session_window("s", F.concat(F.col("us").cast("string"), F.lit(" microseconds"))).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("us"))
        .select(*keys, F.col("__shard").alias("shard"), F.col("w.start").alias("s"), F.col("w.end").alias("e"), "n", "us")
    )
    if several:
        whole = _across(cut_lineage(local), keys)
    else:
        whole = local.select(*keys, "shard", F.col("s").alias("start_at"), F.col("e").alias("end_at"), F.col("n").alias("n_rows"), "us")
    nxt = sharded_neighbours(whole, keys, ["start_at"], "shard", {"next_start": ("start_at", 1)}, 1, several)
    return nxt.select(*show, "start_at", "end_at", "n_rows", (F.col("us") > micros("end_at") - micros("start_at")).alias("overlaps"), "next_start")


def _across(local: DataFrame, keys: list[str]) -> DataFrame:
    """Join the periods of an entity's stretches (``shard``) where they go on from one into the next."""
    before = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy(*keys, "shard").agg(F.max("e").alias("last")).withColumn("carry", F.max("last").over(before)).drop("last")
    begun = local.join(ends, [*keys, "shard"]).withColumn("new", F.col("carry").isNull() | (F.col("s") > F.col("carry"))).drop("carry")
    starts = begun.groupBy(*keys, "shard").agg(F.max(F.when(F.col("new"), F.struct("s", "shard"))).alias("last")).withColumn("open", F.max("last").over(before)).drop("last")
    at = F.when(F.col("new"), F.struct("s", "shard")).otherwise(F.col("open"))
    joined = begun.join(starts, [*keys, "shard"]).withColumn("at", at)
    return joined.groupBy(*keys, F.col("at.shard").alias("shard"), F.col("at.s").alias("start_at")).agg(F.max("e").alias("end_at"), F.sum("n").alias("n_rows"), F.sum("us").alias("us"))


def interval_gaps(periods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The time between each period of :func:`merge_intervals` and the entity's next: ``keys, start_at, end_at``."""
    return periods.where(F.col("next_start").isNotNull()).select(*keys, F.col("end_at").alias("start_at"), F.col("next_start").alias("end_at"))

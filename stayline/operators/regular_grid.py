"""Irregular readings onto a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.common import aside, require


def regular_grid(df: DataFrame, keys: Sequence[str], period: str, value: str, tie: str | None = None, shard_size: int = 168) -> DataFrame:
    """One row per source and period from its first to its last reading: ``keys, period, value, n_readings, filled_value, is_missing``.

    ``period`` is the integer number of the grid period; rows without it or without a key are no readings. Several
    readings in a period give the latest by ``tie`` (then the largest value); ``n_readings`` counts them, repeated rows
    too. A period without a reading has ``is_missing`` and carries the last known value in ``filled_value`` (null if there
    is none yet). A reading whose value is null still is a reading. An empty input gives no rows.

    Readings are pre-aggregated per period, then each source is cut into shards of ``shard_size`` periods. Of every shard
    only its last period and last known value go into a prefix scan over the source's shards; with that carried-in state
    all shards are filled independently, so that one hot source is spread over many tasks.
    """
    require(df, [*keys, period, value])
    if taken := {"period", "value", "n_readings", "filled_value", "is_missing"} & set(keys):
        raise ValueError(f"a key can't have the name of a result: {', '.join(taken)}")
    keys, hide, show = aside(keys)
    rank = F.struct((F.col(tie) if tie else F.lit(0)).alias("t"), F.col(value).alias("v"))
    read = (
        df.select(*hide, F.col(period).cast("bigint").alias("period"), F.when(F.col(value).isNotNull(), rank).alias("rank"))
        .dropna(subset=[*keys, "period"])
        .groupBy(*keys, "period")
        .agg(F.max("rank").alias("top"), F.count(F.lit(1)).alias("n_readings"))
        .select(*keys, "period", F.col("top.v").alias("value"), "n_readings", F.floor(F.col("period") / shard_size).cast("bigint").alias("shard"))
    )
    known = F.when(F.col("value").isNotNull(), F.struct("period", "value"))
    before = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        read.groupBy(*keys, "shard")
        .agg(F.max("period").alias("last"), F.max(known).alias("known"))
        .withColumn("carry_period", F.max("last").over(before))
        .withColumn("carry_value", F.max("known").over(before)["value"])
        .drop("last", "known")
    )
    inside = Window.partitionBy(*keys, "shard").orderBy("period")
    state = (
        read.join(carry, [*keys, "shard"])
        .withColumn("prev", F.coalesce(F.lag("period").over(inside), F.col("carry_period")))
        .withColumn("old", F.coalesce(F.last("value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry_value")))
    )
    # shard by shard, so that no list is longer than a shard or a source's shards, however long a gap is
    first = F.coalesce(F.col("prev") + 1, F.col("period"))
    over = state.withColumn("first", first).withColumn("sh", F.explode(F.sequence(F.floor(F.col("first") / shard_size), F.col("shard"))))
    low, high = F.greatest(F.col("first"), F.col("sh") * shard_size), F.least(F.col("period"), F.col("sh") * shard_size + (shard_size - 1))
    grid = over.withColumn("p", F.explode(F.sequence(low, high)))
    here = F.col("p") == F.col("period")
    return grid.select(
        *show, F.col("p").alias("period"), F.when(here, F.col("value")).alias("value"), F.when(here, F.col("n_readings")).otherwise(F.lit(0)).alias("n_readings"),
        F.when(here, F.coalesce("value", "old")).otherwise(F.col("old")).alias("filled_value"), (~here).alias("is_missing"),
    )

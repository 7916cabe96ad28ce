"""Deterministic sampling: every draw comes from a hash of the row's key, so it is the same on every run and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.hashing import uniform
from stayline.operators.common import attach, cut_lineage, join_dimension


def draw(seed: str, *keys: str) -> Column:
    """A uniform number in (0, 1) for a row's key."""
    return uniform(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def rarity_weights(facts: DataFrame, sample: Sequence[str], path: str, alpha: float = 3.0, eps: float = 1e-10) -> DataFrame:
    """Weight per sample: the power mean of -ln(f + eps) over its facts, f being a path's frequency relative to the commonest.

    ``weight`` sums to 1. Frequencies are pre-aggregated; the two totals are one-row aggregates.
    """
    counts = facts.groupBy(path).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    w = counts.transform(attach, most).select(path, (-F.log(F.col("n") / F.col("most") + eps)).alias("w"))
    per = join_dimension(facts.select(*sample, path), w, [path]).groupBy(*sample).agg(F.pow(F.avg(F.pow(F.greatest("w", F.lit(0.0)), F.lit(alpha))), F.lit(1 / alpha)).alias("raw"))
    return normalize(per, "raw", "weight")


def normalize(df: DataFrame, raw: str, name: str) -> DataFrame:
    """Shares of the sum; null where the sum is 0."""
    total = df.agg(F.sum(raw).alias("__t"))
    return df.transform(attach, total).withColumn(name, F.try_divide(F.col(raw), F.col("__t"))).drop("__t")


def weighted_without_replacement(df: DataFrame, keys: Sequence[str], weight: str, k: int, seed: str) -> DataFrame:
    """``k`` rows with probability by weight, without replacement: the smallest -ln(u) / w. Rows without positive weight are never drawn.

    A top-k over the cluster: each task keeps k rows, so no total sort takes place.
    """
    d = df.where(F.col(weight) > 0).withColumn("__k", -F.log(draw(seed, *keys)) / F.col(weight))
    return d.orderBy("__k", *keys).limit(k).drop("__k")


def uniform_without_replacement(df: DataFrame, keys: Sequence[str], k: int, seed: str) -> DataFrame:
    return df.withColumn("__k", draw(seed, *keys)).orderBy("__k", *keys).limit(k).drop("__k")


def uniform_fraction(df: DataFrame, keys: Sequence[str], fraction: float, seed: str) -> DataFrame:
    """About a fraction of the rows, by hash alone: no shuffle at any size."""
    return df.where(draw(seed, *keys) < fraction)


def weighted_with_replacement(df: DataFrame, key: str, weight: str, k: int, seed: str, buckets: int = 1024) -> DataFrame:
    """``k`` independent draws by weight: ``draw, key``. Two levels: a draw picks a hash bucket by the buckets' summed weights (a
    bounded table), then a row in the bucket by its cumulative weight there, so no running sum spans the whole table."""
    d = df.where(F.col(weight) > 0).select(key, F.col(weight).alias("__w")).withColumn("__b", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    w = Window.partitionBy("__b").orderBy(key)
    d = cut_lineage(d.withColumn("__hi", F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__lo", F.col("__hi") - F.col("__w")))
    tot = d.groupBy("__b").agg(F.sum("__w").alias("__t"))
    acc = tot.withColumn("__end", F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))
    bounds = acc.agg(F.array_sort(F.collect_list(F.struct("__end", "__b", "__t"))).alias("__bounds"), F.max("__end").alias("__all"))  # at most ``buckets`` entries
    draws = df.sparkSession.range(k).select(F.col("id").alias("draw")).withColumn("__u", uniform(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"))))
    hit = draws.transform(attach, bounds).withColumn("__x", F.get(F.filter("__bounds", lambda x: x["__end"] > F.col("__u") * F.col("__all")), F.lit(0)))
    at = hit.select("draw", F.col("__x.__b").alias("__b"), (F.col("__u") * F.col("__all") - (F.col("__x.__end") - F.col("__x.__t"))).alias("__p"))
    return at.join(d, "__b").where((F.col("__p") >= F.col("__lo")) & (F.col("__p") < F.col("__hi"))).select("draw", key)


def take(df: DataFrame, group: str, keys: Sequence[str], seed: str, want: DataFrame) -> DataFrame:
    """Of each group as many rows as ``want`` (``group, __k``) says, chosen by hash; all of a group that has fewer, none of one that isn't named.

    A row's rank within its group is settled by a threshold over hash buckets, then exactly in the one bucket that the
    threshold falls into, so that a group with most of the rows isn't sorted in one task.
    """
    d = df.where(F.col(group).isNotNull()).withColumn("__u", draw(seed, *keys)).withColumn("__b", F.floor(F.col("__u") * 4096).cast("int"))
    per = d.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    run = per.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__b")) - F.col("__n")).join(F.broadcast(want), group)
    edge = run.where(F.col("__before") < F.col("__k")).withColumn("__room", F.col("__k") - F.col("__before")).select(group, "__b", "__n", "__room")
    kept = d.join(edge, [group, "__b"])
    whole = kept.where("__n <= __room")
    w = Window.partitionBy(group).orderBy("__u", *keys)
    part = kept.where("__n > __room").withColumn("__r", F.row_number().over(w)).where("__r <= __room").drop("__r")
    return whole.unionByName(part).drop("__u", "__b", "__n", "__room")


def balance(df: DataFrame, label: str, keys: Sequence[str], seed: str, cap: int | None = None) -> DataFrame:
    """As many rows of each label as the rarest has (at most ``cap``), chosen by hash (see :func:`take`)."""
    totals = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__t"))
    least = totals.agg(F.min("__t").alias("__k"))
    least = least.withColumn("__k", F.least("__k", F.lit(cap))) if cap else least
    return take(df, label, keys, seed, totals.select(label).transform(attach, least))


def inverse_prevalence(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Weight per record: the mean of ln(1 + neg / (pos + 1e-5)) over its labels."""
    total = labels.agg(F.countDistinct(key).alias("__t"))
    w = labels.groupBy(label).agg(F.count(F.lit(1)).alias("__p")).transform(attach, total).select(label, F.log1p((F.col("__t") - F.col("__p")) / (F.col("__p") + 1e-5)).alias("__w"))
    return join_dimension(labels, w, [label]).groupBy(key).agg(F.avg("__w").alias("weight"))


def log_group_weights(df: DataFrame, group: str) -> DataFrame:
    """Sampling probability per group, proportional to ln(count)."""
    return normalize(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("__l", F.log("n")), "__l", "p").drop("__l")


def drop_entries(m: Column, key: Column, fraction: float, seed: str) -> Column:
    """A map without a fraction of its entries, by hash of row key and entry key, but never without all: the last one by hash stays."""
    u = lambda k: uniform(F.concat_ws("|", F.lit(seed), key.cast("string"), k))
    top = F.array_max(F.transform(F.map_keys(m), lambda k: F.struct(u(k).alias("u"), k.alias("k"))))["k"]
    return F.map_filter(m, lambda k, _v: (u(k) >= fraction) | (k == top))


def choose(key: Column, seed: str, options: Sequence[tuple[str, float]]) -> Column:
    """One of the options by cumulative probability; the last takes the rest."""
    u, acc = uniform(F.concat_ws("|", F.lit(seed), key.cast("string"))), 0.0
    out = None
    for name, p in options[:-1]:
        acc += p
        out = F.when(u < acc, F.lit(name)) if out is None else out.when(u < acc, F.lit(name))
    return out.otherwise(F.lit(options[-1][0])) if out is not None else F.lit(options[-1][0])

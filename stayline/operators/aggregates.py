"""Aggregations over long events: pivots with defined order, mixed means, ordered texts, roll-ups, power means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.common import attach


def first_known(value: Column, *order: Column) -> Column:
    """The value at the least order among those that aren't null."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*order)))


def last_known(value: Column, *order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def sum_or_zero(value: Column) -> Column:
    """A sum that is 0.0 where all values are null."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def mean_or_last(num: Column, text: Column, *order: Column) -> tuple[Column, Column]:
    """(mean of the numbers if there is one, else null; the last text if there is no number, else null)."""
    return F.avg(num), F.when(F.count(num) == 0, last_known(text, *order))


def pivot_points(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence, value: Column, prefix: str = "") -> DataFrame:
    """Long to wide with a given list of labels; rows with a null key or label are dropped, as are rows all null."""
    agg = [F.max(F.when(F.col(label) == x, F.col("__v"))).alias(f"{prefix}{x}") for x in labels]
    per = df.dropna(subset=[*keys, label]).groupBy(*keys, label).agg(value.alias("__v"))
    return per.groupBy(*keys).agg(*agg).dropna(how="all", subset=[f"{prefix}{x}" for x in labels])


def pivot_with_info(df: DataFrame, keys: Sequence[str], label: str, labels: Sequence, value: Column, info: dict[str, Column], prefix: str = "") -> DataFrame:
    """:func:`pivot_points` with further columns per label (``info``: suffix to aggregate), all from one grouping instead of a join of pivots."""
    per = df.dropna(subset=[*keys, label]).groupBy(*keys, label).agg(value.alias("__v"), *[c.alias(f"__i_{n}") for n, c in info.items()])
    cols = [F.max(F.when(F.col(label) == x, F.col("__v"))).alias(f"{prefix}{x}") for x in labels]
    more = [F.max(F.when(F.col(label) == x, F.col(f"__i_{n}"))).alias(f"{prefix}{x}_{n}") for x in labels for n in info]
    return per.groupBy(*keys).agg(*cols, *more).dropna(how="all", subset=[f"{prefix}{x}" for x in labels])


def ordered_text(value: Column, order: Column, sep: str = "; ") -> Column:
    """Texts joined in order; ties by the text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))), lambda x: x["v"]), sep)


def power_mean(x: Column, alpha: float = 3.0) -> Column:
    """(mean of x^alpha)^(1/alpha)."""
    return F.pow(F.avg(F.pow(x, F.lit(alpha))), F.lit(1.0 / alpha))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``, by an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__t"))
    return g.select(*keys, *[F.col("__t")[c].alias(c) for c in rest])


def rollup_text(df: DataFrame, group: Sequence[str], outer: str, inner: str, skip: str = "none") -> DataFrame:
    """Per group ``a: [x, y], b: [z]``: inner values by outer value, both sorted and distinct, without ``skip``; null if nothing is left."""
    one = df.where(F.col(inner).isNotNull() & (F.col(inner) != skip)).groupBy(*group, outer).agg(F.array_sort(F.collect_set(inner)).alias("xs"))
    text = F.concat(F.col(outer), F.lit(": ["), F.array_join("xs", ", "), F.lit("]"))
    full = one.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("rollup"))
    return df.select(*group).distinct().join(full, list(group), "left")


def relative_frequency(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, shares of all rows, and shares relative to the commonest value. The total is a one-row aggregate, no global window."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"), F.max("n").alias("__most"))
    return counts.transform(attach, total).select(*by, "n", (F.col("n") / F.col("__all")).alias("share"), (F.col("n") / F.col("__most")).alias("of_most"))

"""Joins of longitudinal data: natural, dictionary, latest, containment in intervals, and matches with a time tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.operators.common import join_dimension


def natural_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all shared columns, null matching null; there must be one."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no shared column")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"__r_{k}" for k in keys])


def with_dictionary(df: DataFrame, dictionary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a dictionary of unique keys; broadcast while it is small, salted beyond."""
    return join_dimension(df, dictionary, keys)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in a total order. Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The row with the greatest (``at``, ``tie``) per key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = df.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("__t"))
    return top.select(*keys, *[F.col("__t")[c].alias(c) for c in rest])


def append_addenda(notes: DataFrame, links: DataFrame, note_id: str, parent_id: str, text: str, at: str, sep: str = "\n") -> DataFrame:
    """Notes with the texts of their addenda appended in order of ``at``; the addenda themselves are left out.

    ``links`` names each addendum (``note_id``) and its parent; one whose parent isn't there vanishes with it. Notes without text count as
    empty, addenda without text add nothing. A parent's addenda are few. An addendum of an addendum goes to that one and vanishes.
    """
    n = notes.select(F.col(note_id).alias("__n"), F.col(text).alias("__x"), F.col(at).alias("__at"))
    pairs = links.select(F.col(note_id).alias("__n"), F.col(parent_id).alias("__p")).distinct()
    more = pairs.join(n, "__n").groupBy("__p").agg(F.array_sort(F.collect_list(F.when(F.col("__x").isNotNull(), F.struct("__at", "__n", "__x")))).alias("__m"))
    own = notes.join(links.select(note_id).distinct(), note_id, "left_anti")
    joined = own.join(more.withColumnRenamed("__p", note_id), note_id, "left")
    parts = F.concat(F.array(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.transform("__m", lambda m: m["__x"]), F.array().cast("array<string>")))
    return joined.withColumn(text, F.array_join(parts, sep)).drop("__m")


def within_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, tie: str, strict: bool = False) -> DataFrame:
    """Each point with the first interval of its key that contains it (``start <= at <= end``, or ``<`` if strict), else nulls.

    An equi-join on the key and on the days that an interval touches keeps a hot key spread over its days; intervals
    longer than a day are listed once per day. ``points`` must be free of the intervals' columns other than the keys, and of maps.
    Equal points are answered once and given back as often as they came.
    """
    same = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("__copies"))
    p = same.withColumn("__day", F.to_date(at))
    ok = intervals.where(F.col(end) >= F.col(start))
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY"))
    spans = ok.withColumn("__day", F.explode(days))
    inside = ((F.col(start) < F.col(at)) & (F.col(at) < F.col(end))) if strict else F.col(at).between(F.col(start), F.col(end))
    cols = [c for c in intervals.columns if c not in keys]
    j = p.join(spans, [*keys, "__day"], "left").withColumn("__in", inside)
    best = j.groupBy(*points.columns, "__copies").agg(F.min(F.when(F.col("__in"), F.struct(F.col(start).alias("__s"), F.col(tie).alias("__t"), *cols))).alias("__b"))
    out = best.select(*points.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))).alias("__c"), *[F.col("__b")[c].alias(c) for c in cols])
    return out.drop("__c")


def _band(df: DataFrame, at: str, tol: int) -> Column:
    """Buckets of width ``tol`` (at least 1 s) that hold a time or a neighbour within the tolerance."""
    b = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(max(tol, 1) * 1_000_000))
    return F.explode(F.array(b - 1, b, b + 1))


def tolerant(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, tol_seconds: int, how: str) -> DataFrame:
    """Rows of ``left`` with (``left_semi``) or without (``left_anti``) a row of ``right`` of equal keys within the tolerance.

    Matching is not one-to-one. Time buckets beside the keys keep a hot key's rows apart. Rows without a time match nothing.
    """
    b = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(max(tol_seconds, 1) * 1_000_000))
    lft = left.withColumn("__b", b)
    rgt = right.select(*keys, F.col(at).alias("__at"), _band(right, at, tol_seconds).alias("__b"))
    gap = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__at").cast("timestamp"))) <= F.lit(tol_seconds * 1_000_000)
    cond = [lft[k] == rgt[k] for k in keys] + [lft["__b"] == rgt["__b"], gap]
    out = cond[0]
    for c in cond[1:]:
        out = out & c
    return lft.join(rgt, out, how).select(*left.columns)


def tolerant_pairs(pred: DataFrame, truth: DataFrame, keys: Sequence[str], at: str, value: str, tol_seconds: int) -> DataFrame:
    """All (prediction, truth) pairs of equal keys within the tolerance: ``keys, at, value, gt_at, gt_value``.

    Bounded by the readings of a key within twice the tolerance.
    """
    b = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(max(tol_seconds, 1) * 1_000_000))
    p = pred.select(*keys, at, value).withColumn("__b", b)
    t = truth.select(*keys, F.col(at).alias("gt_at"), F.col(value).alias("gt_value"), _band(truth, at, tol_seconds).alias("__b"))
    gap = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("gt_at").cast("timestamp"))) <= F.lit(tol_seconds * 1_000_000)
    return p.join(t, [*keys, "__b"]).where(gap).drop("__b")


def nearest_value(pred: DataFrame, truth: DataFrame, keys: Sequence[str], at: str, value: str, tol_seconds: int) -> DataFrame:
    """Each prediction with the truth within the tolerance whose value is nearest (the earlier on ties); without one, no row.

    The choice is an aggregate (``min_by``), so a prediction's candidates are reduced before the shuffle.
    """
    d = F.struct(F.abs(F.col(value) - F.col("gt_value")), F.col("gt_at"), F.col("gt_value"))
    m = tolerant_pairs(pred, truth, keys, at, value, tol_seconds).groupBy(*keys, at, value).agg(F.min_by(F.struct("gt_at", "gt_value"), d).alias("m"))
    return m.select(*keys, at, value, F.col("m.gt_at").alias("gt_at"), F.col("m.gt_value").alias("gt_value"))


def any_equal(pred: DataFrame, truth: DataFrame, keys: Sequence[str], at: str, value: str, tol_seconds: int) -> DataFrame:
    """Each prediction that has a truth within the tolerance, and whether one of them is equal."""
    return tolerant_pairs(pred, truth, keys, at, value, tol_seconds).groupBy(*keys, at, value).agg(F.bool_or(F.col(value) == F.col("gt_value")).alias("equal"))

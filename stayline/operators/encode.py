"""Encoders of hourly histories: periods of activity and runs of values, as rows and as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.numeric import text_of


def interval_ends(df: DataFrame, keys: Sequence[str], start: str, tie: str, last: Column) -> DataFrame:
    """Each row ends where the next of its key starts; the last one at ``last``. Adds ``end_at``."""
    w = Window.partitionBy(*keys).orderBy(start, tie)
    return df.withColumn("end_at", F.coalesce(F.lead(start).over(w), last))


def islands(df: DataFrame, keys: Sequence[str], hour: str) -> DataFrame:
    """Runs of consecutive hours per key: ``keys, first, last``. ``hour`` is an integer; repeated hours count once, before the shuffle, so a key has no more rows than time has hours."""
    one = df.select(*keys, F.col(hour).alias("h")).dropna(subset=["h"]).distinct()
    w = Window.partitionBy(*keys).orderBy("h")
    return one.withColumn("g", F.col("h") - F.row_number().over(w)).groupBy(*keys, "g").agg(F.min("h").alias("first"), F.max("h").alias("last")).drop("g")


def _span(first: Column, last: Column, now: Column) -> Column:
    a, b = (now - first).cast("string"), (now - last).cast("string")
    return F.when(first == last, a).otherwise(F.concat_ws("-", a, b))


def period_text(isl: DataFrame, keys: Sequence[str], now: Column, keep: int | None = None) -> DataFrame:
    """``start-end`` hours ago of each island, oldest first, joined by commas: ``keys, periods, n``.

    A single hour stands alone. With ``keep``, once there are more than ``keep + 3`` islands only the latest ``keep`` are
    listed, behind ``{n}x in past, current: `` (n counts the others).
    """
    rows = F.array_sort(F.collect_list(F.struct("first", _span(F.col("first"), F.col("last"), now).alias("t"))))
    g = isl.groupBy(*keys).agg(rows.alias("r")).withColumn("n", F.size("r"))
    every = F.array_join(F.transform("r", lambda x: x["t"]), ",")
    if keep is None:
        return g.select(*keys, every.alias("periods"), "n")
    late = F.array_join(F.transform(F.slice("r", -keep, keep), lambda x: x["t"]), ",")
    cut = F.concat((F.col("n") - keep).cast("string"), F.lit("x in past, current: "), late)
    return g.select(*keys, F.when(F.col("n") > keep + 3, cut).otherwise(every).alias("periods"), "n")


def interleaved_text(isl: DataFrame, keys: Sequence[str], label: str, now: Column) -> DataFrame:
    """Islands of all labels of a key by start: ``start-end: label``, even for one hour, joined by commas."""
    t = F.concat((now - F.col("first")).cast("string"), F.lit("-"), (now - F.col("last")).cast("string"), F.lit(": "), F.col(label))
    rows = F.array_sort(F.collect_list(F.struct("first", "last", t.alias("t"))))
    return isl.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["t"]), ", ").alias("periods"))


def value_runs(df: DataFrame, keys: Sequence[str], hour: str, value: str, tail: int = 5) -> DataFrame:
    """Runs of equal values in hour order: ``keys, run, value, first, last, n, recent, hours``.

    The last ``tail`` observations form runs of their own (``recent``), so that a run over the cut gives two rows. Rows with a
    null value are skipped; one row per key and hour is assumed. ``hours`` are those of the run, in order.
    """
    d = df.where(F.col(value).isNotNull())
    up = Window.partitionBy(*keys).orderBy(hour)
    down = Window.partitionBy(*keys).orderBy(F.col(hour).desc())
    d = d.withColumn("recent", F.row_number().over(down) <= tail)
    fresh = ~F.lag(value).over(up).eqNullSafe(F.col(value)) | (F.lag("recent").over(up) != F.col("recent"))
    d = d.withColumn("run", F.sum(fresh.cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "run").agg(F.first(value).alias("value"), F.min(hour).alias("first"), F.max(hour).alias("last"), F.count(F.lit(1)).alias("n"), F.first("recent").alias("recent"), F.array_sort(F.collect_list(hour)).alias("hours"))


def run_text(runs: DataFrame, keys: Sequence[str], now: Column, unit: str = "") -> DataFrame:
    """``6-5: 80, 4: 80, 3/2/1: 90, 0: 100``: older runs as spans, the recent ones hour by hour, in hours (or ``unit``) ago."""
    old = _span(F.col("first"), F.col("last"), now)
    new = F.array_join(F.transform("hours", lambda h: (now - h).cast("string")), "/")
    t = F.concat(F.when(F.col("recent"), new).otherwise(old), F.lit(f"{unit}: "), F.col("value"))
    return runs.withColumn("__t", t).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "__t"))), lambda x: x["__t"]), ", ").alias("values"))


def run_text_of(entries: Column, now: Column, tail: int = 5) -> Column:
    """What :func:`value_runs` and :func:`run_text` give, of an array of ``(h, s)`` structs: for groups of bounded size, such as the hours of a trailing window.

    Entries are put in order first; those without ``s`` are skipped; none give null.
    """
    known = F.sort_array(F.filter(entries, lambda x: x["s"].isNotNull()))
    # the inner lambda sees the sorted array as a variable, so that it is sorted once
    flagged = F.get(F.transform(F.array(known), lambda k: F.transform(k, lambda x, i: F.struct(x["h"].alias("h"), x["s"].alias("s"), (i >= F.size(k) - tail).alias("r")))), F.lit(0))
    none = lambda t: F.lit(None).cast(t)
    zero = F.struct(F.array().cast("array<string>").alias("out"), none("string").alias("s"), none("boolean").alias("r"), none("bigint").alias("a"), none("bigint").alias("b"), none("string").alias("hs"))

    def token(acc: Column) -> Column:
        span = F.when(acc["a"] == acc["b"], acc["a"].cast("string")).otherwise(F.concat_ws("-", acc["a"].cast("string"), acc["b"].cast("string")))
        return F.concat(F.when(acc["r"], acc["hs"]).otherwise(span), F.lit(": "), acc["s"])

    def step(acc: Column, x: Column) -> Column:
        goes_on, ago = (acc["s"] == x["s"]) & (acc["r"] == x["r"]), (now - x["h"]).cast("bigint")
        went_on = F.struct(acc["out"].alias("out"), acc["s"].alias("s"), acc["r"].alias("r"), acc["a"].alias("a"), ago.alias("b"), F.concat(acc["hs"], F.lit("/"), ago.cast("string")).alias("hs"))
        begun = F.struct(F.when(acc["s"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(token(acc)))).alias("out"), x["s"].alias("s"), x["r"].alias("r"), ago.alias("a"), ago.alias("b"), ago.cast("string").alias("hs"))
        return F.when(F.coalesce(goes_on, F.lit(False)), went_on).otherwise(begun)

    return F.aggregate(flagged, zero, step, lambda acc: F.when(acc["s"].isNotNull(), F.array_join(F.concat(acc["out"], F.array(token(acc))), ", ")))


def flagged_run_text(k: Column, now: Column, tail: int = 5) -> Column:
    """What :func:`run_text_of` gives, of entries in order, one an hour: ``(h, s, same, cont)`` structs, ``same`` and ``cont`` telling whether the next and the one before have the same ``s``."""

    def piece(x: Column, i: Column) -> Column:
        left, ago = F.size(k) - i, (now - x["h"]).cast("string")  # left: how many there are from here on
        end, start = ~x["same"] | (left == 1) | (left == tail + 1), ~x["cont"] | (i == 0)
        said = F.concat(F.lit(": "), x["s"], F.when(left > 1, ", ").otherwise(""))
        return F.when(left <= tail, F.concat(ago, F.when(end, said).otherwise("/"))).when(end, F.concat(F.when(start, "").otherwise("-"), ago, said)).when(start, ago).otherwise("")

    return F.array_join(F.transform(k, piece), "")


def last_with_rest(df: DataFrame, keys: Sequence[str], hour: str, num: str, now: Column, keep: int = 1) -> DataFrame:
    """``past: max-min, mean: m, recent: h: v``: the latest ``keep`` values, the rest summed up once there are more than ``keep + 3``.

    With fewer values they are all listed. The rest is an aggregate, never a list.
    """
    d = df.where(F.col(num).isNotNull())
    w = Window.partitionBy(*keys)
    d = d.withColumn("rd", F.row_number().over(w.orderBy(F.col(hour).desc()))).withColumn("n", F.count(F.lit(1)).over(w))
    old = (F.col("n") > keep + 3) & (F.col("rd") > keep)
    item = F.when(~old, F.struct((-F.col("rd")).alias("o"), F.concat((now - F.col(hour)).cast("string"), F.lit(": "), text_of(F.col(num))).alias("t")))
    g = d.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(old, F.col(num))).alias("hi"), F.min(F.when(old, F.col(num))).alias("lo"), F.avg(F.when(old, F.col(num))).alias("m"), F.array_sort(F.collect_list(item)).alias("r"))
    late = F.array_join(F.transform("r", lambda x: x["t"]), ", ")
    past = F.concat(F.lit("past: "), text_of(F.col("hi")), F.lit("-"), text_of(F.col("lo")), F.lit(", mean: "), text_of(F.round("m", 6)), F.lit(", recent: "), late)
    return g.select(*keys, F.when(F.col("n") > keep + 3, past).otherwise(late).alias("values"))


def majority_with_recent(df: DataFrame, keys: Sequence[str], hour: str, value: str, now: Column, keep: int = 1) -> DataFrame:
    """``past: majority: v, recent: h: v`` for words; the commonest older value, the least on ties. Values packed by commas are de-duplicated."""
    clean = F.array_join(F.array_distinct(F.transform(F.split(value, ","), lambda x: F.trim(x))), ", ")
    d = df.where(F.col(value).isNotNull()).select(*keys, hour, clean.alias("v"))
    w = Window.partitionBy(*keys)
    d = d.withColumn("rd", F.row_number().over(w.orderBy(F.col(hour).desc(), "v"))).withColumn("n", F.count(F.lit(1)).over(w))
    old = (F.col("n") > keep + 3) & (F.col("rd") > keep)
    item = F.when(~old, F.struct((-F.col("rd")).alias("o"), F.concat((now - F.col(hour)).cast("string"), F.lit(": "), F.col("v")).alias("t")))
    late = d.groupBy(*keys).agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ").alias("late"), F.mode(F.when(old, F.col("v")), True).alias("top"))
    return late.select(*keys, F.when(F.col("n") > keep + 3, F.concat(F.lit("past: majority: "), "top", F.lit(", recent: "), "late")).otherwise(F.col("late")).alias("values"))

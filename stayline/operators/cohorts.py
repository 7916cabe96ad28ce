"""Cohorts and labels over stays: time points, windows of the future, one-hot classes, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators.common import attach


def one_hot(values: Column, names: Sequence[str]) -> Column:
    """0/1 per name, in order, by membership."""
    return F.array(*[F.array_contains(values, F.lit(n)).cast("int") for n in names])


def every(df: DataFrame, start: Column, end: Column, hours: int, name: str = "t") -> DataFrame:
    """Time points from ``start`` to at most ``end`` in steps; none if the end is before the start."""
    return df.withColumn("__a", start).withColumn("__b", end).where("__b >= __a").withColumn(name, F.explode(F.sequence("__a", "__b", F.expr(f"INTERVAL {hours} HOURS")))).drop("__a", "__b")


def future(events: DataFrame, points: DataFrame, keys: Sequence[str], at: str, hours: int, tolerance: int = 0, t: str = "t") -> DataFrame:
    """Events in (t, t + hours + tolerance] of each time point; joined on hour buckets of that width beside the keys."""
    width = (hours + tolerance) * 3600
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000
    b = lambda c: F.floor(sec(c) / width).cast("bigint")
    e = events.withColumn("__b", F.explode(F.array(b(at) - 1, b(at))))
    return points.withColumn("__b", b(t)).join(e, [*keys, "__b"]).where((F.col(at) > F.col(t)) & (sec(at) <= sec(t) + width)).drop("__b")


def sections_of(facts: DataFrame, dimension: DataFrame, sample: Sequence[str], path: str) -> DataFrame:
    """Sections present in each sample: facts whose path starts with a section's prefix. ``dimension`` is a short fixed list."""
    names = dimension.agg(F.collect_list(F.struct("prefix", "section")).alias("__names"))
    hit = F.filter("__names", lambda x: F.startswith(F.col(path), x["prefix"]))
    return facts.transform(attach, names).select(*sample, F.explode(hit).alias("__x")).select(*sample, F.col("__x.section").alias("section")).distinct()


def top_of(counts: DataFrame, group: Sequence[str], value: str, n: str, k: Column) -> DataFrame:
    """The ``k`` commonest values per group (least value first on ties), as an array; ``k`` is an aggregate of the group."""
    order = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("n"), F.col(value).alias("v")))), lambda x: x["v"])
    return counts.groupBy(*group).agg(order.alias("__o"), k.alias("__k")).select(*group, F.slice("__o", 1, F.greatest(F.col("__k").cast("int"), F.lit(0))).alias("top"))


def map_codes(codes: DataFrame, mapping: DataFrame, code: str, source: str, target: str) -> DataFrame:
    """Codes brought over by a mapping, every target of a code; codes without one fall out. Null codes too."""
    m = mapping.select(F.trim(source).alias("__s"), F.trim(target).alias(target)).dropna().distinct()
    return codes.withColumn("__s", F.trim(code)).join(m, "__s").drop("__s")


def rank_split(keys: DataFrame, key: str, seed: str, train: float = 0.95, val: float = 0.025) -> DataFrame:
    """Distinct keys in hash order, the first ``int(n * train)`` in train, the next ``int(n * val)`` in val, the rest in test: ``key, split``."""
    from stayline.operators.budget import row_numbers
    from stayline.operators.sampling import draw

    p = keys.select(key).dropna().distinct().withColumn("__u", draw(seed, key))
    r = row_numbers(p, "__u", key).transform(attach, p.agg(F.count(F.lit(1)).alias("__n")))
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * val)
    return r.select(key, F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "val").otherwise("test").alias("split"))


# -- cohorts of tasks: which points, with which label ----------------------------------------------------------------------
def ed_admission(ed: DataFrame) -> DataFrame:
    """Emergency stays with hours that ended in an admission (1) or at home (0), at their first point: ``stay_id, label``."""
    e = ed.where(F.col("disposition").isin("ADMITTED", "HOME") & (F.col("ed_stay_hours") > 0))
    return e.select("stay_id", (F.col("disposition") == "ADMITTED").cast("int").alias("label")).distinct()


def icu_long_stay(icu: DataFrame, after_hours: int = 24, limit_hours: int = 72) -> DataFrame:
    """ICU stays still going on after ``after_hours``, and whether they last for more than ``limit_hours`` from then: ``stay_id, t, label``."""
    t = F.col("intime") + F.expr(f"INTERVAL {after_hours} HOURS")
    return icu.where(F.col("outtime") > t).select("stay_id", t.alias("t"), (F.col("outtime") - t > F.expr(f"INTERVAL {limit_hours} HOURS")).alias("label")).distinct()


def icu_long_stay_path(icu: DataFrame, first: int = 24, last: int = 96) -> DataFrame:
    """Every hour of an ICU stay from ``first`` to ``last`` hours in, as far as it lasts: ``stay_id, t``. Open stays have none."""
    h = lambda n: F.col("intime") + F.expr(f"INTERVAL {n} HOURS")
    i = icu.where("outtime IS NOT NULL").select("stay_id", "intime", "outtime").distinct()
    return every(i, h(first), F.least("outtime", h(last)), 1).select("stay_id", "t")


def icu_mortality(icu: DataFrame, deaths: DataFrame, step: int = 10, horizon: int = 24) -> DataFrame:
    """Points every ``step`` hours from an ICU stay's first hour to its end or the death, and whether the patient dies within ``horizon`` hours and
    before the stay is over: ``stay_id, t, label``. ``deaths``: ``hadm_id, death``."""
    i = icu.where("outtime > intime").select("stay_id", "hadm_id", "intime", "outtime").distinct().join(deaths, "hadm_id", "left")
    p = every(i, F.col("intime") + F.expr("INTERVAL 1 HOUR"), F.least("outtime", F.coalesce("death", "outtime")), step)
    soon = (F.col("death") <= F.col("t") + F.expr(f"INTERVAL {horizon} HOURS")) & (F.col("death") <= F.col("outtime"))
    return p.select("stay_id", "t", F.coalesce(soon, F.lit(False)).alias("label"))


def random_hours(stays: DataFrame, key: str, hours: str, seed: str) -> DataFrame:
    """One hour of each stay, drawn by hash from its whole hours (0 for shorter ones): ``key, hour_idx``. Stays of unknown length have none."""
    from stayline.operators.sampling import draw

    d = stays.where(F.col(hours).isNotNull())
    return d.select(key, F.floor(draw(seed, key) * F.greatest(F.floor(hours), F.lit(1))).alias("hour_idx")).distinct()


def hospital_mortality(admissions: DataFrame) -> DataFrame:
    """Admissions whose end is known, and whether the patient died: ``hadm_id, label``."""
    return admissions.where("hospital_expire_flag IS NOT NULL").groupBy("hadm_id").agg(F.max("hospital_expire_flag").cast("int").alias("label"))

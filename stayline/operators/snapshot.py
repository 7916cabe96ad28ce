"""The hour grid, stays and what is known of them as of an hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.time import HOUR_US, hour_ceil, hour_floor, micros


def hour_expand(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per hour from the floored start to the ceiled end: adds ``hour``.

    A missing bound is an hour from the other; without both, and where the end is before the start, there are no rows.
    """
    a = F.coalesce(F.col(start), F.col(end) - F.expr("INTERVAL 1 HOUR"))
    b = F.coalesce(F.col(end), F.col(start) + F.expr("INTERVAL 1 HOUR"))
    d = df.withColumn("__a", hour_floor(a)).withColumn("__b", hour_ceil(b)).where((b >= a) & F.col("__a").isNotNull())
    return d.withColumn("hour", F.explode(F.sequence("__a", "__b", F.expr("INTERVAL 1 HOUR")))).drop("__a", "__b")


def last_writer(df: DataFrame, keys: Sequence[str], info: str, order: Sequence[str]) -> DataFrame:
    """Per key and hour the info of the last row in order."""
    return df.groupBy(*keys, "hour").agg(F.max_by(info, F.struct(*order)).alias(info))


def until(events: DataFrame, points: DataFrame, keys: Sequence[str], at: str, t: str = "t", trailing_hours: int | None = None, closed: bool = False, by_date: bool = False) -> DataFrame:
    """Events known at each time point: ``at <= t``, within the trailing hours if given: ``(t - N, t]``, or ``[t - N, t]`` if ``closed``.

    With ``by_date`` the lower bound compares dates: ``date(at) >= date(t - N)``. Events are joined, never copied per state;
    with a trailing window the join is on the key and hour buckets of that width, so that an event meets two buckets of
    time points and a long history costs nothing.
    """
    p = points
    if trailing_hours is None:
        return p.join(events, list(keys)).where(F.col(at) <= F.col(t))
    low = F.col(t) - F.expr(f"INTERVAL {trailing_hours} HOURS")
    days = 1 if by_date else 0
    width = (trailing_hours + 24 * days) * HOUR_US + 1
    b = lambda c: F.floor(micros(c) / F.lit(width)).cast("bigint")
    e = events.withColumn("__b", F.explode(F.array(b(at), b(at) + 1)))
    after = F.to_date(at) >= F.to_date(low) if by_date else (F.col(at) >= low if closed else F.col(at) > low)
    return p.withColumn("__b", b(t)).join(e, [*keys, "__b"]).where((F.col(at) <= F.col(t)) & after).drop("__b")


def exactly(events: DataFrame, points: DataFrame, keys: Sequence[str], at: str, t: str = "t") -> DataFrame:
    """Events whose hour is the time point's: an equi-join."""
    return points.join(events.withColumn("__t", F.col(at)), [*[points[k] == events[k] for k in keys], F.col("__t") == F.col(t)]).drop("__t").drop(*[events[k] for k in keys])


def timepoints(stays: DataFrame, start: str, hours: Column) -> DataFrame:
    """The time points of each stay: ``timepoint`` 0 (before anything), 1, ... with ``hour_idx`` = timepoint - 1 and ``t``."""
    n = F.greatest(F.floor(hours).cast("int"), F.lit(0))
    p = stays.withColumn("timepoint", F.explode(F.sequence(F.lit(0), n + 1))).withColumn("hour_idx", F.col("timepoint") - 1)
    return p.withColumn("t", F.col(start) + F.make_dt_interval(F.lit(0), F.col("hour_idx")))


def hospital_hour(hour_idx: Column, ed_hours: Column) -> Column:
    """Hour of the hospital clock of an hour index, after an emergency stay of ``ed_hours`` (null or 0: none): two ticks lie between."""
    return F.when(F.coalesce(ed_hours, F.lit(0)) > 0, hour_idx - (ed_hours + 2)).otherwise(hour_idx)


def build_stays(admissions: DataFrame, icustays: DataFrame, ed: DataFrame) -> DataFrame:
    """One record per admission with its ICU stays and its latest emergency stay, and one per emergency stay without admission.

    ``stay_id, patient_id, adm_id, icu_stay_ids, ed_stay_id, ed_stay_hours, hosp_stay_hours``. All joins are by admission; the
    ICU stays of an admission are few.
    """
    a = admissions.select("subject_id", "hadm_id", "admittime", "dischtime").distinct()
    i = icustays.select("hadm_id", "stay_id").dropna().distinct().groupBy("hadm_id").agg(F.array_sort(F.collect_list("stay_id")).alias("icu_stay_ids"))
    top = F.max_by(F.struct("stay_id", "ed_stay_hours"), F.struct("intime", "stay_id")).alias("e")
    e = ed.where("hadm_id IS NOT NULL").groupBy("hadm_id").agg(top).select("hadm_id", F.col("e.stay_id").alias("ed_stay_id"), F.col("e.ed_stay_hours").alias("ed_stay_hours"))
    full = a.join(i, "hadm_id", "left").join(e, "hadm_id", "left").select(
        F.concat_ws("_", "subject_id", "hadm_id").alias("stay_id"), F.col("subject_id").alias("patient_id"), F.col("hadm_id").alias("adm_id"),
        F.coalesce("icu_stay_ids", F.array().cast("array<int>")).alias("icu_stay_ids"), "ed_stay_id", F.coalesce("ed_stay_hours", F.lit(0.0)).alias("ed_stay_hours"),
        ((micros("dischtime") - micros("admittime")) / F.lit(float(HOUR_US))).alias("hosp_stay_hours"),
    )
    lone = ed.where("hadm_id IS NULL").select("subject_id", "stay_id", "ed_stay_hours").distinct().select(
        F.concat_ws("_", "subject_id", "stay_id").alias("stay_id"), F.col("subject_id").alias("patient_id"), F.lit(None).cast("int").alias("adm_id"),
        F.array().cast("array<int>").alias("icu_stay_ids"), F.col("stay_id").alias("ed_stay_id"), "ed_stay_hours", F.lit(None).cast("double").alias("hosp_stay_hours"),
    )
    return full.unionByName(lone)


def segments(admissions: DataFrame, icustays: DataFrame, ed: DataFrame) -> DataFrame:
    """All parts of stays as rows: ``subject_id, hadm_id, segment_id, stay_type, start_at, end_at, hours``."""
    part = lambda df, kind, sid, a, b: df.select("subject_id", "hadm_id", F.col(sid).alias("segment_id"), F.lit(kind).alias("stay_type"), F.col(a).alias("start_at"), F.col(b).alias("end_at")).distinct()
    u = part(admissions, "admission", "hadm_id", "admittime", "dischtime").unionByName(part(icustays, "icu", "stay_id", "intime", "outtime")).unionByName(part(ed, "ed", "stay_id", "intime", "outtime"))
    return u.withColumn("hours", (micros("end_at") - micros("start_at")) / F.lit(float(HOUR_US)))


#: How each kind of source is cut at a time point: whether the trailing bound is closed, and whether it compares dates. Fixed values.
BOUNDS = {"transfers": {"closed": True}, "services": {}, "labs": {}, "prescriptions": {}, "notes": {}, "omr": {"by_date": True}, "procedures": {"by_date": True}, "icu": {}, "ed": {}}


def as_of(source: str, events: DataFrame, points: DataFrame, keys: Sequence[str], at: str, t: str = "t", trailing_hours: int | None = None) -> DataFrame:
    """:func:`until` with the bounds of the source's kind."""
    return until(events, points, keys, at, t, trailing_hours, **BOUNDS[source])


def phase(hour_idx: Column, ed_hours: Column) -> Column:
    """Where a stay is at an hour index: ``ed`` up to the last emergency hour, ``admitted`` for the tick after it, ``hospital`` from then on."""
    e = F.coalesce(ed_hours, F.lit(0))
    return F.when((e > 0) & (hour_idx <= e), "ed").when((e > 0) & (hour_idx == e + 1), "admitted").otherwise("hospital")


def begun(events: DataFrame, t: Column, start: Column) -> DataFrame:
    """Nothing of a part of a stay is known before it begins."""
    return events.where(t >= start)

"""Samples for a task: weights of rare outcomes, cohorts drawn by weight and balanced, and rows of label, description and what comes later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.operators import sampling as X
from stayline.operators.common import attach, join_dimension
from stayline.operators.visits import ADM, ED, ICU, describe_visit, known_at, los_facts, single_entries

#: The ordinary outcome against which the others of its kind are weighed. Fixed values.
USUAL = {
    "adm_end": f"{ADM}.Disposition.DISCHARGED", "ed_end": f"{ED}.Disposition.DISCHARGED",
    "adm_icd": f"{ADM}.ICD categories.circulatory", "ed_icd": f"{ED}.ICD categories.unknown",
}


def event_weights(paths: DataFrame, points: DataFrame, alpha: float = 3.0, eps: float = 1e-10) -> DataFrame:
    """Weight of each point (``visit, timepoint``) by how rare its events are: ``visit, timepoint, raw, weight``; ``weight`` sums to 1.

    ``paths``: the flat names of the points' changes (:func:`stayline.operators.changes.flat_paths`). With f the share of a name in all events, an event weighs -ln(f); a disposition
    of the emergency or hospital stay as much as an ordinary discharge, times how much rarer it is; a diagnosis category half of that, against the
    ordinary category; leaving an ICU -ln(f). Categories and ICU dispositions make one weight together, the power mean; the point's weight is the power
    mean of that and the others. Points without an event weigh as much as the commonest one. Names are counted before they are joined.
    """
    n = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.max("n").alias("most"), *[F.max(F.when(F.col("path") == p, F.col("n"))).alias(k) for k, p in USUAL.items()])
    f = lambda c: F.coalesce(F.col(c), F.col("most")) / F.col("total") + eps
    notes = F.contains("path", F.lit("MDProgressNote"))
    end, icd = F.contains("path", F.lit("Disposition")) & ~notes, F.contains("path", F.lit("ICD categories"))
    starts = lambda p: F.startswith("path", F.lit(p))
    own = f("n")
    against = lambda usual: -F.log(f(usual)) * (f(usual) / own)
    w = (
        F.when(end & starts(ADM), against("adm_end")).when(end & starts(ED), against("ed_end")).when(end, -F.log(own))
        .when(icd & starts(ADM), against("adm_icd") / 2).when(icd & starts(ED), against("ed_icd") / 2).otherwise(-F.log(own))
    )
    pooled = icd | (end & starts(ICU))
    named = n.transform(attach, total).select("path", w.alias("w"), pooled.alias("pooled"))
    power = lambda c: F.pow(F.avg(F.pow(c, F.lit(alpha))), F.lit(1.0 / alpha))
    e = join_dimension(paths, named, ["path"])
    one = e.groupBy("visit", "timepoint").agg(power(F.when(F.col("pooled"), F.col("w"))).alias("p"), F.sum(F.when(~F.col("pooled"), F.pow("w", F.lit(alpha)))).alias("s"), F.count_if(~F.col("pooled")).alias("c"))
    got = one.select("visit", "timepoint", F.pow((F.coalesce("s", F.lit(0.0)) + F.coalesce(F.pow("p", F.lit(alpha)), F.lit(0.0))) / (F.col("c") + F.col("p").isNotNull().cast("int")), F.lit(1.0 / alpha)).alias("raw"))
    full = points.select("visit", "timepoint").distinct().join(got, ["visit", "timepoint"], "left").transform(attach, total.select("most", "total"))
    full = full.withColumn("raw", F.coalesce("raw", -F.log(F.col("most") / F.col("total") + eps))).drop("most", "total")
    return X.normalize(full, "raw", "weight")


def resample(cohort: DataFrame, keys: Sequence[str], label: str | None, size: int, seed: str, weight: str | None = None, repeat: bool = False) -> DataFrame:
    """A task's training points out of its cohort: ``size`` of them at most, by weight or evenly, then as many of each label as of the rarest.

    ``repeat`` draws with repetition (``draw`` numbers the draws; labels, usually several, aren't balanced then). Weights needn't sum to 1; rows without
    positive weight are never drawn. Every draw is a hash of the keys and the seed.
    """
    base = cohort if weight else cohort.withColumn("__one", F.lit(1.0))
    if repeat:
        named = base.withColumn("__key", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
        drawn = X.weighted_with_replacement(named, "__key", weight or "__one", size, seed)
        return drawn.join(named, "__key").drop("__key", "__one")
    drawn = X.weighted_without_replacement(base, keys, weight or "__one", size, seed).drop("__one")
    return X.balance(drawn, label, keys, f"{seed}|balance") if label else drawn


def multilabel_weights(labels: DataFrame, keys: Sequence[str], codes: str, names: Sequence[str]) -> DataFrame:
    """Weight of each record by the inverse prevalence of its codes: the mean of ln(1 + neg / (pos + 1e-5)) over those it has, the least of all if it has none."""
    one = labels.select(*keys, F.explode_outer(F.array_distinct(F.filter(codes, lambda c: c.isin(*names)))).alias("__c"))
    total = labels.agg(F.count(F.lit(1)).alias("__t"))
    w = one.where("__c IS NOT NULL").groupBy("__c").agg(F.count(F.lit(1)).alias("__p")).transform(attach, total).select("__c", F.log1p((F.col("__t") - F.col("__p")) / (F.col("__p") + 1e-5)).alias("__w"))
    least = w.agg(F.min("__w").alias("__least"))
    return join_dimension(one, w, ["__c"]).groupBy(*keys).agg(F.avg("__w").alias("weight")).transform(attach, least).select(*keys, F.coalesce("weight", "__least").alias("weight"))


def later(points: DataFrame, ends: DataFrame) -> DataFrame:
    """What comes of a stay, as facts under a point: ``Future Disposition`` (how the part ends), ``24h Disposition`` (the same if it ends within 24 hours, else
    ALIVE) and ``StayOver3days`` (whether it goes on for more than 72 hours): ``visit, timepoint, path, value``. ``ends``: ``visit, part, end_at, value``."""
    p = points.join(ends, "visit").where(F.col("end_at") >= F.col("t"))
    hours = (F.unix_micros(F.col("end_at").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 3.6e9
    told = F.array(
        F.struct(F.array("part", F.lit("Future Disposition")).alias("path"), F.col("value").alias("value")),
        F.struct(F.array("part", F.lit("24h Disposition")).alias("path"), F.when(hours <= 24, F.col("value")).otherwise(F.lit("ALIVE")).alias("value")),
        F.struct(F.array("part", F.lit("StayOver3days")).alias("path"), F.when(hours > 72, F.lit("STAYED")).otherwise(F.lit("DISCHARGED")).alias("value")),
    )
    return p.select("visit", "timepoint", F.explode(told).alias("f")).select("visit", "timepoint", "f.path", "f.value")


def visit_samples(history: DataFrame, points: DataFrame, changes: DataFrame, ends: DataFrame | None = None, mode: str = "24h", level: int = 0, held_out: bool = False, seed: str = "sample") -> DataFrame:
    """Samples of the points asked for: ``visit, timepoint, desc, change``, facts in path order.

    ``mode``: ``24h`` describes the last 24 hours, ``all`` the whole history, ``los`` only the hours left. The hours left (``ends`` as in
    :func:`stayline.operators.visits.los_facts`) are blurred or dropped by hash, and never told where ``held_out``.
    """
    if mode not in ("24h", "all", "los"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "24h" and level <= 1 and (ends is None or held_out):  # all but single entries is written in place, beside the changes
        x = known_at(history, points, 24, changes)
        e = single_entries(history, points, 24, level).groupBy("visit", "timepoint").agg(F.collect_list(F.struct("path", "value")).alias("e"))
        x = x.join(e, ["visit", "timepoint"], "left")
        return x.select("visit", "timepoint", F.array_sort(F.concat("facts", F.coalesce("e", F.array().cast(dict(x.dtypes)["facts"])))).alias("desc"), F.col("future").alias("change"))
    told = describe_visit(history, points, 24 if mode == "24h" else None, level) if mode != "los" else None
    if ends is not None and not held_out:
        left = los_facts(points, ends, "noise", seed)
        told = left if told is None else told.unionByName(left)
    if told is None:
        told = changes.limit(0)
    return task_rows(points.select("visit", "timepoint").withColumn("label", F.lit(None).cast("string")), told, changes).select("visit", "timepoint", "desc", F.col("future").alias("change"))


def task_rows(cohort: DataFrame, described: DataFrame, future: DataFrame | None = None, label: str = "label") -> DataFrame:
    """One row per cohort point: ``visit, timepoint, label, desc`` (facts in path order) and ``future`` facts. Points without facts have empty lists."""
    key = ["visit", "timepoint"]
    fold = lambda df, name: df.join(cohort.select(*key).distinct(), key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias(name))
    none: Column = F.expr("CAST(ARRAY() AS ARRAY<STRUCT<path: ARRAY<STRING>, value: STRING>>)")
    out = cohort.select(*key, label).join(fold(described, "desc"), key, "left").withColumn("desc", F.coalesce("desc", none))
    if future is None:
        return out
    return out.join(fold(future, "future"), key, "left").withColumn("future", F.coalesce("future", none))

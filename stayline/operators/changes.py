"""Change logs of visits: what the next hour brings as facts, their flat names, their text read back with types, and the state they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayline.functions.nested import nested_facts, nested_text
from stayline.functions.numeric import text_of, to_number
from stayline.functions.text import strip_unit
from stayline.operators.common import broadcast_if_small
from stayline.operators.visits import ADM, ED, ICU, path_of

#: How each section of a change log is to be read. Fixed values.
SECTION_KINDS = {
    (ED, "Vital Measurements"): "value", (ED, "Medication"): "active", (ED, "LOS"): "los", (ED, "Disposition"): "end", (ED, "ICD categories"): "icd",
    (ADM, "LOS"): "los", (ADM, "Patient Location"): "active", (ADM, "Care Taker"): "active", (ADM, "Lab Results"): "value", (ADM, "Microbiology Growth Results"): "each",
    (ADM, "Prescriptions"): "active", (ADM, "Procedures"): "each", (ADM, "Disposition"): "end", (ADM, "ICD categories"): "icd",
    (ICU, "LOS"): "los", (ICU, "Medication"): "active", (ICU, "Output"): "value", (ICU, "Procedures"): "active", (ICU, "Chart Events"): "value", (ICU, "Disposition"): "end",
}
#: Between the entries of a list, and between diagnosis categories.
LIST, CODES = "; ", ";"


def with_next(points: DataFrame) -> DataFrame:
    """Points with the time of the next one, and whether they are the last emergency hour or the last hour of all: ``next_t, last_ed, last``."""
    w = Window.partitionBy("visit")
    ed = F.max(F.when(F.col("phase") == "ed", F.col("hour_idx"))).over(w)
    return points.withColumns({
        "next_t": F.coalesce(F.lead("t").over(w.orderBy("timepoint")), F.col("t") + F.expr("INTERVAL 1 HOUR")),
        "last_ed": F.coalesce((F.col("phase") == "ed") & (F.col("hour_idx") == ed), F.lit(False)),
        "last": F.col("hour_idx") == F.max("hour_idx").over(w),
    })


def end_cases(ed: DataFrame, admissions: DataFrame) -> DataFrame:
    """How parts of visits end: ``visit, part, value``. An emergency stay ends in death, in an admission (said so, or a later discharge from
    hospital), else in discharge; a hospital stay in death or discharge. ``ed``: ``visit, disposition, outtime``; ``admissions``: ``visit, discharge_location, dischtime``."""
    later = admissions.select("visit", F.col("dischtime").alias("__d"))
    e = ed.join(later, "visit", "left")
    how = F.when(F.col("disposition") == "EXPIRED", "DIED").when((F.col("disposition") == "ADMITTED") | (F.col("__d") > F.col("outtime")), "ADMITTED").otherwise("DISCHARGED")
    a = admissions.select("visit", F.lit(ADM).alias("part"), F.when(F.col("discharge_location") == "DIED", "DIED").otherwise("DISCHARGED").alias("value"))
    return e.select("visit", F.lit(ED).alias("part"), how.alias("value")).unionByName(a)


def change_facts(history: DataFrame, points: DataFrame, icu: DataFrame, ends: DataFrame, codes: DataFrame, los: DataFrame | None = None) -> DataFrame:
    """Facts ``visit, timepoint, path, value`` of the hour after each point.

    ``points`` from :func:`with_next`; ``icu``: ``visit, sub, intime, outtime`` on the hour grid; ``ends`` from :func:`end_cases`; ``codes``: ``visit, part, value`` (diagnosis
    categories joined by ``;``); ``los``: exact hours left of a part, if they are to be told. Readings give the mean of the hour's numbers or its
    last text, activities the list of their labels (of locations and care takers the first), cultures and procedures their entries, reports nothing. Entering and leaving
    an ICU are dispositions. The last emergency hour tells only the categories and how it ended, the last hour of all the same of the hospital stay. Parts without facts
    don't appear; an ICU stay has none before it begins.
    """
    going = points.where("NOT last_ed AND NOT last").select("visit", "timepoint", F.col("next_t").alias("hour"))
    begun = icu.select("visit", "sub", F.col("intime").alias("__in"))
    now = going.join(history.where("kind IN ('value', 'active', 'each') AND section <> 'Radiology Notes' AND section <> 'Outpatient Measurements'"), ["visit", "hour"]).join(begun, ["visit", "sub"], "left")
    now = now.where(f"part <> '{ICU}' OR __in IS NULL OR hour >= __in").drop("__in")
    key = ["visit", "timepoint", "part", "sub", "section", "category"]
    v = now.where("kind = 'value'").groupBy(*key, "label").agg(F.avg("num").alias("m"), F.max("text").alias("x"))
    text = F.coalesce(text_of(F.round("m", 6)), F.when(F.col("section") == "Chart Events", strip_unit(F.col("x"))).otherwise(F.col("x")))
    out = v.select("visit", "timepoint", path_of().alias("path"), text.alias("value")).where("value IS NOT NULL")
    one = F.col("section").isin("Patient Location", "Care Taker")
    a = now.where("kind = 'active'").groupBy(*key).agg(F.array_sort(F.collect_set("label")).alias("x")).withColumn("label", F.lit(""))
    out = out.unionByName(a.select("visit", "timepoint", path_of().alias("path"), F.when(one, F.get("x", F.lit(0))).otherwise(F.array_join("x", LIST)).alias("value")))
    tests = F.col("section") == "Microbiology Growth Results"
    e = now.where("kind = 'each'").withColumn("label", F.when(tests, F.col("label")).otherwise(F.lit("")))
    e = e.groupBy(*key, "label").agg(F.array_sort(F.collect_set(F.regexp_replace("text", " antibiotics: .*$", ""))).alias("x"))
    out = out.unionByName(e.select("visit", "timepoint", path_of().alias("path"), F.when(tests, F.array_join("x", ", ")).otherwise(F.array_join("x", LIST)).alias("value")))
    fact = lambda df, value, *path: df.select("visit", "timepoint", F.filter(F.array(*path), lambda x: x != "").alias("path"), F.lit(value).alias("value"))
    out = out.unionByName(fact(going.join(icu, (going["visit"] == icu["visit"]) & (going["hour"] == icu["intime"])).select(going["visit"], "timepoint").distinct(), "ADMITTED TO ICU", F.lit(ADM), F.lit("Disposition")))
    out = out.unionByName(fact(going.join(icu, (going["visit"] == icu["visit"]) & (going["hour"] == icu["outtime"])).select(going["visit"], "timepoint", "sub"), "DISCHARGED FROM ICU", F.lit(ICU), F.col("sub"), F.lit("Disposition")))
    if los is not None:
        out = out.unionByName(los.join(going.select("visit", "timepoint"), ["visit", "timepoint"], "left_semi"))
    over = points.where("last_ed").select("visit", "timepoint", F.lit(ED).alias("part")).unionByName(points.where("last AND NOT last_ed").select("visit", "timepoint", F.lit(ADM).alias("part")))
    tell = lambda df, name: over.join(df, ["visit", "part"]).select("visit", "timepoint", F.array("part", F.lit(name)).alias("path"), "value")
    return out.unionByName(tell(ends, "Disposition")).unionByName(tell(codes, "ICD categories"))


def flat_paths(facts: DataFrame) -> DataFrame:
    """Dotted names of facts, ``visit, timepoint, path``: what a disposition says and each diagnosis category become part of the name; progress notes keep theirs."""
    dotted = F.array_join("path", ".")
    notes = F.array_contains("path", "MDProgressNote")
    last = F.element_at("path", -1)
    names = F.when((last == "Disposition") & ~notes, F.array(F.concat(dotted, F.lit("."), "value"))).when(last == "ICD categories", F.transform(F.split("value", CODES), lambda c: F.concat(dotted, F.lit("."), F.trim(c)))).otherwise(F.array(dotted))
    return facts.select("visit", "timepoint", F.explode(names).alias("path"))


def change_text(facts: DataFrame) -> DataFrame:
    """One nested text per visit and point: ``visit, timepoint, text``; facts in the order of their paths."""
    g = facts.groupBy("visit", "timepoint").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("facts"))
    return g.select("visit", "timepoint", nested_text(F.col("facts")).alias("text"))


def typed_facts(facts: DataFrame) -> DataFrame:
    """Facts with their parts told apart: ``visit, timepoint, part, sub, section, category, label, kind, num, text``.

    A fact of no known part and section, of the wrong depth, without value, or whose list is empty falls out, and nothing else with it. Lists give a row per entry;
    readings a number where their text is one; hours left the number in front.
    """
    known = F.create_map(*[x for (p, s), k in SECTION_KINDS.items() for x in (F.lit(f"{p}|{s}"), F.lit(k))])
    in_icu = F.get("path", F.lit(0)) == ICU
    p = facts.withColumn("part", F.get("path", F.lit(0))).withColumn("sub", F.when(in_icu, F.get("path", F.lit(1))).otherwise(F.lit("")))
    p = p.withColumn("rest", F.slice("path", F.when(in_icu, 3).otherwise(2), F.size("path"))).withColumn("section", F.get("rest", F.lit(0)))
    p = p.withColumn("kind", F.try_element_at(known, F.concat_ws("|", "part", "section"))).withColumn("n", F.size("rest"))
    chart = F.col("section") == "Chart Events"
    p = p.withColumn("category", F.when(chart & (F.col("n") == 3), F.get("rest", F.lit(1))).otherwise(F.lit(""))).withColumn("leaf", F.when(F.col("n") > 1, F.element_at("rest", -1)).otherwise(F.lit("")))
    fits = F.when(F.col("kind") == "value", (F.col("n") == 2) | (chart & (F.col("n") == 3))).when(F.col("section") == "Microbiology Growth Results", F.col("n") == 2).otherwise(F.col("n") == 1)
    p = p.where(F.col("kind").isNotNull() & fits & F.col("value").isNotNull() & (F.trim("value") != "") & (~in_icu | F.col("sub").rlike(r"^Stay \d+$")))
    split = F.when(F.col("kind").isin("active") | (F.col("section") == "Procedures"), F.split("value", LIST)).when(F.col("kind") == "icd", F.split("value", CODES)).otherwise(F.array("value"))
    p = p.withColumn("entry", F.explode(F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")))
    hours = F.regexp_extract("entry", r"^(-?\d+)", 1).try_cast("double")
    return p.select(
        "visit", "timepoint", "part", "sub", "section", "category", F.when(F.col("kind") == "active", F.col("entry")).otherwise(F.col("leaf")).alias("label"), "kind",
        F.when(F.col("kind") == "value", to_number(F.col("entry"))).when(F.col("kind") == "los", hours).alias("num"), F.when(F.col("kind") != "active", F.col("entry")).alias("text"),
    )


def read_changes(texts: DataFrame, text: str = "text") -> DataFrame:
    """Typed facts of nested texts (``visit, timepoint, text``); broken lines are passed over with what hangs on them."""
    each = texts.select("visit", "timepoint", F.explode(nested_facts(F.col(text))).alias("f"))
    return typed_facts(each.select("visit", "timepoint", "f.path", "f.value"))


def fold(history: DataFrame, typed: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history with the changes appended at the next hour, endings ``visit, timepoint, part, sub, value``).

    Readings, activities, cultures and procedures become rows of the hour; a reading has the unit that its label had before. Facts of points that
    aren't there fall out. Entering an ICU is an ending of nothing but shows among them; hours left aren't part of the state.
    """
    when = points.select("visit", "timepoint", F.col("next_t").alias("hour"))
    new = typed.where("kind IN ('value', 'active', 'each')").join(when, ["visit", "timepoint"])
    units = history.where("unit IS NOT NULL").groupBy("part", "section", "category", "label").agg(F.min("unit").alias("unit"))
    new = new.join(broadcast_if_small(units), ["part", "section", "category", "label"], "left")
    kinds = dict(history.dtypes)
    rows = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in history.columns])
    return history.unionByName(rows), typed.where("kind = 'end'").select("visit", "timepoint", "part", "sub", F.col("text").alias("value"))


def over(endings: DataFrame, only_ed: Column | bool = False, only_icu: Column | bool = False) -> DataFrame:
    """Visits that a step has ended, ``visit, ended_by``: a death or discharge of the emergency or hospital stay, any disposition where only the emergency stay
    is followed, the release where only the ICU is."""
    lit = lambda x: F.lit(x) if isinstance(x, bool) else x
    ed = (F.col("part") == ED) & (F.col("value").isin("DIED", "DISCHARGED") | lit(only_ed))
    adm = (F.col("part") == ADM) & F.col("value").isin("DIED", "DISCHARGED", "ALIVE", "STAYED")
    icu = (F.col("part") == ICU) & lit(only_icu)
    return endings.where(ed | adm | icu).groupBy("visit").agg(F.min("value").alias("ended_by"))

"""Visits as long histories: an admission with its ICU stays and its emergency stay, the clock of its hours, and what is known at each as text.

A history has one row per hour and fact: ``visit, part, sub, section, category, label, kind, hour, num, text, unit, low, high``. ``part`` is the emergency,
hospital or ICU stay, ``sub`` tells ICU stays apart, ``kind`` says how a section is written: ``value`` (readings), ``active`` (hours in which
something went on), ``each`` (single entries by their age) or ``fixed`` (known from the part's beginning). Tables that are missing are passed over, so a history can be built of what there is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.codes import SERVICES, in_words
from stayline.functions.hashing import uniform
from stayline.functions.numeric import text_of, to_number
from stayline.functions.text import GFR_LABEL, GFR_PHRASES, GFR_UNIT, impression, one_of_each, replace_chain
from stayline.functions.time import hour_index, hour_round, hours_between, micros
from stayline.operators import encode as E
from stayline.operators.joins import append_addenda, with_dictionary
from stayline.operators.snapshot import hour_expand

ED, ADM, ICU = "Emergency Department Stay", "Hospital Stay", "ICU Stay"
#: Sections whose trailing bound is closed, and those dated by the day. Fixed values.
CLOSED, BY_DATE = ("Patient Location",), ("Outpatient Measurements", "Procedures by day")
#: Sections whose labels are written in one text. Fixed values.
TOGETHER = ("Patient Location", "Care Taker")
#: Vital signs of an emergency stay with their units. Fixed values.
ED_VITALS = {"temperature": " (F)", "heartrate": " (bpm)", "resprate": " (breaths/min)", "o2sat": " (%)", "sbp": "", "dbp": "", "rhythm": "", "pain": " (1-10)"}
TRIAGE = {"temperature": "F", "heartrate": "bpm", "resprate": "breaths/min", "o2sat": "%", "sbp": "", "pain": "/10"}
_SCHEMA = "visit string, part string, sub string, section string, category string, label string, kind string, hour timestamp_ntz, num double, text string, unit string, low double, high double"


def _rows(df: DataFrame, part: str, section: str, kind: str, hour: Column, label: Column | str = "", num: Column | None = None, text: Column | None = None, unit: Column | None = None, low: Column | None = None, high: Column | None = None, category: Column | None = None) -> DataFrame:
    void = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    sub = F.col("sub") if "sub" in df.columns else F.lit("")
    out = df.select(
        F.col("visit").cast("string").alias("visit"), F.lit(part).alias("part"), sub.alias("sub"), F.lit(section).alias("section"), (F.lit("") if category is None else category).alias("category"),
        (F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(kind).alias("kind"), hour.cast("timestamp_ntz").alias("hour"),
        void(num, "double").alias("num"), void(text, "string").alias("text"), void(unit, "string").alias("unit"), void(low, "double").alias("low"), void(high, "double").alias("high"),
    )
    return out.where("label IS NOT NULL AND hour IS NOT NULL")


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.sparkSession.createDataFrame([], _SCHEMA)
    for p in parts:
        out = out.unionByName(p)
    return out


def _at(core: DataFrame, tables: Mapping[str, DataFrame], name: str, keys: Sequence[str]) -> DataFrame | None:
    """A table's rows of the visits, by the shared keys; None if there is no such table."""
    if name not in tables:
        return None
    df = tables[name].dropna(subset=list(keys))
    return core.join(df.drop(*[c for c in core.columns if c in df.columns and c not in keys]), list(keys))


def build_admission(core: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The history of hospital stays. ``core``: ``visit, subject_id, hadm_id, admittime, dischtime`` and, if known, what ``General`` is made of.

    Tables by their public names: transfers, services, omr, labevents (with d_labitems), microbiologyevents, prescriptions, procedures_icd (with
    d_icd_procedures), radiology (with radiology_detail), labs (``stay_id, timepoint, lab_results`` as a map, on the visit's clock: ``start``).
    Rows of other admissions, and with a null key or time, are left out. A table's columns that the core has too are taken from the core.
    """
    both, out = ["subject_id", "hadm_id"], []
    if "admission_type" in core.columns:
        c = lambda n, d="unknown": F.lower(F.coalesce(F.col(n).cast("string"), F.lit(d))) if n in core.columns else F.lit(d)
        age = F.concat(F.col("anchor_age").cast("int").cast("string"), F.lit("-year old ")) if "anchor_age" in core.columns else F.lit("")
        sex = F.when(F.col("gender") == "F", "female, ").otherwise("male, ") if "gender" in core.columns else F.lit("")
        general = F.concat(c("admission_type"), F.lit(" patient, "), age, sex, F.lit("insurance: "), F.coalesce("insurance", F.lit("unknown")), F.lit(", "), c("race"), F.lit(", language: "), c("language"))
        out.append(_rows(core, ADM, "General", "fixed", hour_round("admittime"), text=general))
    if (t := _at(core, tables, "transfers", both)) is not None:
        out.append(_rows(hour_expand(t.where("careunit IS NOT NULL"), "intime", "outtime"), ADM, "Patient Location", "active", F.col("hour"), F.col("careunit")))
    if (t := _at(core, tables, "services", both)) is not None:
        t = E.interval_ends(t.where("transfertime IS NOT NULL"), ["visit"], "transfertime", "curr_service", F.col("dischtime"))
        out.append(_rows(hour_expand(t, "transfertime", "end_at"), ADM, "Care Taker", "active", F.col("hour"), in_words(F.col("curr_service"), SERVICES, keep=True)))
    if (t := _at(core, tables, "omr", ["subject_id"])) is not None:
        t = t.where(F.col("result_value").isNotNull() & (F.isnull("dischtime") | (F.col("chartdate") <= F.col("dischtime"))))
        out.append(_rows(t, ADM, "Outpatient Measurements", "value", F.col("chartdate"), F.col("result_name"), text=F.trim("result_value"), num=to_number(F.trim("result_value"))))
    if (t := _at(core, tables, "labevents", both)) is not None:
        t = with_dictionary(t, tables["d_labitems"].select("itemid", "label").dropDuplicates(["itemid"]), ["itemid"])
        num = F.coalesce(F.col("valuenum").try_cast("double"), to_number(F.col("value")))
        out.append(_rows(t, ADM, "Lab Results", "value", hour_round("charttime"), F.col("label"), num=num, text=F.col("value"), unit=F.col("valueuom"), low=F.col("ref_range_lower"), high=F.col("ref_range_upper")))
    if "labs" in tables:
        t = core.join(tables["labs"].withColumnRenamed("stay_id", "visit"), "visit").select("visit", (F.col("start") + F.make_dt_interval(F.lit(0), F.col("timepoint") - 1)).alias("at"), F.explode("lab_results").alias("label", "value"))
        out.append(_rows(t.where("value IS NOT NULL"), ADM, "Lab Results", "value", F.col("at"), F.col("label"), num=to_number(F.col("value")), text=F.col("value")))
    if (t := _at(core, tables, "microbiologyevents", both)) is not None:
        # antibiotics by interpretation, `sensitive: [a, b], resistant: [c]`, without what was not tested
        known = t.where("ab_name IS NOT NULL AND ab_name <> 'none' AND interpretation IS NOT NULL").groupBy("visit", "charttime", "test_name", "org_name", "spec_type_desc", "interpretation").agg(F.array_join(F.array_sort(F.collect_set("ab_name")), ", ").alias("abs"))
        tested = known.groupBy("visit", "charttime", "test_name", "org_name", "spec_type_desc").agg(F.array_join(F.array_sort(F.collect_list(F.concat("interpretation", F.lit(": ["), "abs", F.lit("]")))), ", ").alias("ab"))
        seen = t.select("visit", "charttime", "test_name", "org_name", "spec_type_desc").distinct().join(tested, ["visit", "charttime", "test_name", "org_name", "spec_type_desc"], "left")
        said = F.concat("org_name", F.when(F.col("ab").isNotNull(), F.concat(F.lit(" antibiotics: "), "ab")).otherwise(F.lit("")))
        out.append(_rows(seen, ADM, "Microbiology Growth Results", "each", hour_round("charttime"), F.concat("test_name", F.lit(" - "), F.lower("spec_type_desc")), text=said))
    if (t := _at(core, tables, "prescriptions", both)) is not None:
        out.append(_rows(hour_expand(t, "starttime", "stoptime"), ADM, "Prescriptions", "active", F.col("hour"), F.col("drug")))
    if (t := _at(core, tables, "procedures_icd", both)) is not None:
        d = tables["d_icd_procedures"].select(F.trim("icd_code").alias("icd_code"), F.trim("icd_version").alias("icd_version"), "long_title").dropDuplicates(["icd_code", "icd_version"])
        t = with_dictionary(t.withColumns({"icd_code": F.trim("icd_code"), "icd_version": F.trim("icd_version")}), d, ["icd_code", "icd_version"])
        out.append(_rows(t.where("long_title IS NOT NULL"), ADM, "Procedures", "each", F.col("chartdate"), "", text=F.col("long_title")))
    if (t := _at(core, tables, "radiology", both)) is not None:
        t = note_details(t, tables["radiology_detail"]) if "radiology_detail" in tables else t
        name = F.coalesce("exam_name", F.lit("report")) if "exam_name" in t.columns else F.lit("report")
        out.append(_rows(t.where("text IS NOT NULL"), ADM, "Radiology Notes", "each", hour_round("charttime"), name, text=F.col("text")))
    return _union(out, core)


def note_details(notes: DataFrame, details: DataFrame) -> DataFrame:
    """Notes with the ordered, joined ``exam_name`` and ``exam_code`` of their detail rows, and with their addenda appended and left out themselves.

    Details of other notes are passed over first (semi-join); a note without details keeps nulls; notes without a name are dropped where others have one.
    """
    d = details.join(notes.select("note_id").distinct(), "note_id", "left_semi")
    one = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field_name") == f, F.struct("field_ordinal", "field_value")))), lambda x: x["field_value"]), "; ")
    wide = d.where(F.col("field_name").isin("exam_name", "exam_code")).groupBy("note_id").agg(F.nullif(one("exam_name"), F.lit("")).alias("exam_name"), F.nullif(one("exam_code"), F.lit("")).alias("exam_code"))
    links = d.where("field_name = 'addendum_note_id'").select(F.col("field_value").alias("note_id"), F.col("note_id").alias("parent_id"))
    whole = append_addenda(notes.drop("exam_name", "exam_code"), links, "note_id", "parent_id", "text", "charttime")
    return whole.join(wide, "note_id", "left")


def build_icu(core: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The history of ICU stays. ``core``: ``visit, subject_id, hadm_id, stay_id, intime, outtime, sub`` (which of the visit's stays).

    Tables: inputevents, outputevents, procedureevents, chartevents, each with d_items for labels and categories; without it items are named by their number.
    """
    keys, out = ["stay_id"], []

    def named(name: str) -> DataFrame | None:
        t = _at(core, tables, name, keys)
        if t is None or "d_items" not in tables:
            return None if t is None else t.withColumns({"label": F.col("itemid").cast("string"), "category": F.lit("")})
        d = tables["d_items"].select("itemid", "label", F.regexp_replace(F.regexp_replace(F.coalesce("category", F.lit("")), "/", "_"), " ", "").alias("category")).dropDuplicates(["itemid"])
        return with_dictionary(t.drop("label", "category"), d, ["itemid"])

    if (t := named("inputevents")) is not None:
        out.append(_rows(hour_expand(t, "starttime", "endtime"), ICU, "Medication", "active", F.col("hour"), F.col("label")))
    if (t := named("outputevents")) is not None:
        out.append(_rows(t, ICU, "Output", "value", hour_round("charttime"), F.col("label"), num=F.col("value").try_cast("double"), text=F.col("value").cast("string"), unit=F.col("valueuom")))
    if (t := named("procedureevents")) is not None:
        out.append(_rows(hour_expand(t, "starttime", "endtime"), ICU, "Procedures", "active", F.col("hour"), F.col("label")))
    if (t := named("chartevents")) is not None:
        num = F.coalesce(to_number(F.col("valuenum")), to_number(F.col("value")))
        out.append(_rows(t, ICU, "Chart Events", "value", hour_round("charttime"), F.col("label"), num=num, text=F.col("value"), unit=F.col("valueuom"), category=F.col("category")))
    return _union(out, core)


def build_ed(core: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The history of emergency stays. ``core``: ``visit, stay_id, intime, outtime, gender, race, arrival_transport``.

    Tables: triage, medrecon, vitalsign, pyxis, diagnosis. Vital signs of an hour are averaged or their last text taken when written; a drug counts
    once per time, however many rows it has.
    """
    word = lambda n: F.lower(F.coalesce(F.col(n), F.lit("unknown")))
    start = hour_round("intime")
    general = F.concat(word("arrival_transport"), F.lit(" patient, "), F.when(F.col("gender") == "F", "female, ").otherwise("male, "), word("race"))
    out, keys = [_rows(core, ED, "General", "fixed", start, text=general)], ["stay_id"]
    if (t := _at(core, tables, "triage", keys)) is not None:
        out.append(_rows(t, ED, "Chief Complaint", "fixed", start, text=F.lower(F.coalesce("chiefcomplaint", F.lit("unknown")))))
        for name, unit in TRIAGE.items():
            n = F.col(name).cast("string").try_cast("double")
            out.append(_rows(t.where(F.col(name).isNotNull()), ED, "Admission Vitals", "fixed", start, name, text=F.concat(F.coalesce(n.cast("int").cast("string"), F.col(name).cast("string")), F.lit(unit))))
    if (t := _at(core, tables, "medrecon", keys)) is not None:
        g = t.groupBy("visit", "intime").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
        out.append(_rows(g, ED, "Medicine Reconciliation", "fixed", start, text=F.col("names")))
    if (t := _at(core, tables, "vitalsign", keys)) is not None:
        for name, unit in ED_VITALS.items():
            if name in t.columns:
                v = F.col(name).cast("string")
                out.append(_rows(t.where(F.col(name).isNotNull()), ED, "Vital Measurements", "value", hour_round("charttime"), f"{name}{unit}", num=to_number(v), text=v))
    if (t := _at(core, tables, "pyxis", keys)) is not None:
        out.append(_rows(t.select("visit", "charttime", "name").distinct(), ED, "Medication", "active", hour_round("charttime"), F.col("name")))
    if (t := _at(core, tables, "diagnosis", keys)) is not None:
        g = t.where("lower(icd_title) <> 'unspecified'").groupBy("visit", "outtime").agg(F.array_join(F.array_sort(F.collect_set(F.lower("icd_title"))), ", ").alias("names"))
        out.append(_rows(g, ED, "Diagnosis", "fixed", hour_round("outtime"), text=F.col("names")))
    return _union(out, core)


def visit_points(visits: DataFrame) -> DataFrame:
    """All time points of visits: ``visit, timepoint, hour_idx, phase, t``.

    ``visits``: ``visit, ed_in, ed_out, adm_in, adm_out`` (timestamps, null where there is no such part). Hour -1 stands before anything; then come the
    emergency hours, one tick of being admitted, and the hospital hours, which start two ticks after the last emergency hour.
    """
    span = lambda a, b: F.greatest(F.floor(F.coalesce(hours_between(hour_round(a), hour_round(b)), F.lit(0.0))), F.lit(0)).cast("int")
    v = visits.withColumns({"e": F.when(F.col("ed_in").isNotNull(), span("ed_in", "ed_out")), "h": F.when(F.col("adm_in").isNotNull(), span("adm_in", "adm_out"))})
    has_ed = F.col("ed_in").isNotNull() & (F.col("e") > 0)
    first = F.when(has_ed, F.col("e") + 2).otherwise(F.lit(0))  # the hour index of hospital hour 0
    last = F.when(F.col("h").isNotNull(), first + F.col("h")).otherwise(F.col("e"))
    p = v.where(last.isNotNull()).withColumn("hour_idx", F.explode(F.sequence(F.lit(-1), last)))
    ed_t = hour_round("ed_in") + F.make_dt_interval(F.lit(0), F.col("hour_idx"))
    adm_t = hour_round("adm_in") + F.make_dt_interval(F.lit(0), F.col("hour_idx") - first)
    in_ed = has_ed & (F.col("hour_idx") <= F.col("e"))
    phase = F.when(in_ed, "ed").when(has_ed & (F.col("hour_idx") == F.col("e") + 1), "admitted").otherwise("hospital")
    t = F.when(in_ed | (phase == "admitted"), ed_t).otherwise(F.coalesce(adm_t, ed_t))
    return p.select("visit", (F.col("hour_idx") + 1).alias("timepoint"), "hour_idx", phase.alias("phase"), t.alias("t"))


def _window(history: DataFrame, points: DataFrame, trailing: int | None) -> DataFrame:
    """What of a history is known at each point: up to it, of the trailing hours if given, by the bounds of each section; fixed facts always.

    One equi-join on the visit and, with a trailing window, on buckets of its width, which a row and a point share at one of two places.
    """
    day = F.col("section").isin(*BY_DATE) | ((F.col("section") == "Procedures") & (F.col("kind") == "each"))
    if trailing is None:
        return points.join(history, "visit").where(F.col("hour") <= F.col("t"))
    moving, fixed = history.where("kind <> 'fixed'"), points.join(history.where("kind = 'fixed'"), "visit").where(F.col("hour") <= F.col("t"))
    width = trailing + 25
    b = lambda c: F.floor(hour_index(c) / width).cast("bigint")
    h = moving.withColumn("__b", F.explode(F.array(b("hour"), b("hour") + 1)))
    low = F.col("t") - F.make_dt_interval(F.lit(0), F.lit(trailing))
    later = F.when(day, F.to_date("hour") >= F.to_date(low)).when(F.col("section").isin(*CLOSED), F.col("hour") >= low).otherwise(F.col("hour") > low)
    joined = points.withColumn("__b", b("t")).join(h, ["visit", "__b"]).where((F.col("hour") <= F.col("t")) & later).drop("__b")
    return joined.unionByName(fixed)


def path_of(label: Column | str = "label") -> Column:
    """The path of a row: part, ICU stay, section, category and label, without empty ones."""
    return F.filter(F.array("part", "sub", "section", "category", F.col(label) if isinstance(label, str) else label), lambda x: x != "")


def _hourly(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings of an hour as one: ``m`` the mean of its numbers, ``s`` that as text, else its last text, and its unit and normal range."""
    v = values.groupBy(*keys, "part", "sub", "section", "category", "label", "kind", "hour").agg(F.avg("num").alias("m"), F.max("text").alias("x"), F.min("unit").alias("unit"), F.min("low").alias("low"), F.min("high").alias("high"))
    word = F.when(F.col("label") == GFR_LABEL, replace_chain(F.col("x"), GFR_PHRASES)).otherwise(one_of_each(F.col("x")))
    return v.withColumn("m", F.round("m", 6)).withColumn("s", F.coalesce(text_of(F.col("m")), word)).where("s IS NOT NULL").drop("x")


def _labelled(section: Column, label: Column, unit: Column, low: Column, high: Column, values: Column) -> tuple[Column, Column]:
    """The label with unit and normal range, and the values as they are shown: ages of what is dated by the day are days; millimetres, failing them centimetres, move to the label."""
    shown = F.concat_ws(", ", unit, F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("normal range: "), text_of(low), F.lit("-"), text_of(high))))
    mm, cm = values.rlike(r"\d+mm\b"), values.rlike(r"\d+cm\b")
    chart = section == "Chart Events"
    shown = F.when(chart & mm, "mm").when(chart & cm, "cm").when(F.contains(label, F.concat(F.lit("("), unit, F.lit(")"))), "").when(label == GFR_LABEL, GFR_UNIT).otherwise(shown)
    told = F.when(section.isin(*BY_DATE), F.replace(values, F.lit(": "), F.lit(" days: "))).when(chart & mm, F.regexp_replace(values, r"(\d+)mm\b", "$1")).when(chart & cm, F.regexp_replace(values, r"(\d+)cm\b", "$1")).otherwise(values)
    return F.concat(label, F.when(shown != "", F.concat(F.when(section == "Lab Results", F.lit(" (")).otherwise(F.lit("(")), shown, F.lit(")"))).otherwise(F.lit(""))), told


def _hour_sets(df: DataFrame, keys: Sequence[str], hour: Column) -> DataFrame:
    """The distinct whole hours of each key in order: ``keys, hours``. A day's hours are the bits of one number, so few rows are shuffled and none sorted before that."""
    d = df.select(*keys, hour.alias("__h")).where("__h IS NOT NULL").groupBy(*keys, F.floor(F.col("__h") / 24).alias("__d")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(__h, 24) AS INT))")).alias("__m"))
    return d.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list(F.expr("transform(filter(sequence(0, 23), i -> getbit(__m, i) = 1), i -> __d * 24 + i)")))).alias("hours"))


def known_at(history: DataFrame, points: DataFrame, trailing: int = 24, future: DataFrame | None = None) -> DataFrame:
    """What of a history's readings, activities and fixed facts is known at each point, one row a point: ``visit, timepoint, facts`` (structs of ``path, value``).

    Hours meet points in stretches of time: of each stretch the readings of a label, its periods and the points are one row, from which the texts of all points
    are written in place. So a reading is shuffled once or twice however many points see it, a point hardly at all, and a stretch is bounded however long the visit.
    Points and activities are whole hours of a clock, whose minutes may differ by visit. With ``future``, facts ``visit, timepoint, path, value``, those of the point
    are a fourth column, in path order.
    """
    width, reach, hour_us = 4 * trailing, trailing + 25, 3_600_000_000
    stretch = lambda h: F.floor(h / width).cast("bigint")
    # a row of the last hours of a stretch is seen from the next one too
    seen = lambda h: F.explode(F.when(F.pmod(h, F.lit(width)) >= width - reach, F.array(stretch(h), stretch(h) + 1)).otherwise(F.array(stretch(h))))
    floor_h = lambda us: F.floor(us / F.lit(hour_us)).cast("bigint")
    at, label = ["visit", "__b"], ["part", "sub", "section", "category", "label"]
    # points: their hours, by how far the clock is from the time point's number
    t = micros("t")
    p = points.where("t IS NOT NULL AND timepoint IS NOT NULL").select("visit", stretch(floor_h(t)).alias("__b"), (t - F.col("timepoint").cast("bigint") * hour_us).alias("__off"), floor_h(t).alias("__t"))
    p = _hour_sets(p, [*at, "__off"], F.col("__t"))
    tp = lambda h: F.round((h * hour_us + F.pmod("__off", F.lit(hour_us)) - F.col("__off")) / F.lit(hour_us)).cast("bigint")
    if future is not None:  # by stretches of time points; the hours of a stretch of time are of two of them at most
        block = lambda n: F.floor(n / width).cast("bigint")
        own = ["visit", "__tb"]
        c = future.withColumns({"timepoint": F.col("timepoint").cast("bigint"), "__tb": block(F.col("timepoint"))}).repartition(*[F.col(k) for k in own])
        c = c.groupBy(*own, "timepoint").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("f"))
        c = c.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("timepoint", "f"))).alias("future"))
        p = p.withColumn("__tb", F.explode(F.array_distinct(F.transform("hours", lambda h: block(tp(h)))))).withColumn("hours", F.filter("hours", lambda h: block(tp(h)) == F.col("__tb")))
        p = p.join(c, own, "left").drop("__tb")
    # readings
    v = history.where("kind = 'value'").withColumn("__b", seen(floor_h(micros("hour")))).repartition(*[F.col(c) for c in at])
    days = F.col("section").isin(*BY_DATE)
    # a reading is in the window as long as the window's lower bound is before `till`
    till = F.when(days, (floor_h(micros("hour")) - F.pmod(floor_h(micros("hour")), F.lit(24)) + 24) * hour_us).when(F.col("section").isin(*CLOSED), micros("hour") + 1).otherwise(micros("hour"))
    entry = F.struct(F.when(days, F.datediff("hour", F.lit("1970-01-01")).cast("bigint")).otherwise(hour_index("hour")).alias("h"), "s", micros("hour").alias("at"), till.alias("till"), "unit", "low", "high")
    v = _hourly(v, at).groupBy(*at, *label).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    like = lambda x, i: F.coalesce(F.get("e", i)["s"] == x["s"], F.lit(False))
    v = v.withColumn("e", F.transform("e", lambda x, i: F.struct(*[x[c].alias(c) for c in ("h", "s", "at", "till", "unit", "low", "high")], like(x, i + 1).alias("same"), like(x, i - 1).alias("cont"))))
    units = F.exists("e", lambda x: x["unit"].isNotNull() | x["low"].isNotNull() | x["high"].isNotNull())
    v = v.groupBy(*at).agg(F.collect_list(F.struct(*label, "e", units.alias("units"))).alias("vs"))
    # activities: periods of each label; of locations and care takers all labels together
    a = _hour_sets(history.where("kind = 'active'").withColumn("__b", seen(floor_h(micros("hour")))), [*at, *label], hour_index("hour"))
    edge = lambda step: F.filter("hours", lambda x, i: ~F.coalesce(F.get("hours", i + step) == x + step, F.lit(False)))
    a = a.withColumn("e", F.zip_with(edge(-1), edge(1), lambda x, y: F.struct(x.alias("first"), y.alias("last"), F.col("label").alias("label"))))
    mixed = F.col("section").isin(*TOGETHER)
    a = a.withColumn("label", F.when(mixed, "").otherwise(F.col("label"))).groupBy(*at, *label).agg(F.flatten(F.collect_list("e")).alias("e"))
    a = a.groupBy(*at).agg(F.collect_list(F.struct("section", path_of().alias("path"), "e")).alias("acts"))
    fixed = history.where("kind = 'fixed' AND text IS NOT NULL").groupBy("visit").agg(F.collect_list(F.struct(micros("hour").alias("at"), path_of().alias("path"), F.col("text").alias("value"))).alias("fixed"))
    x = p.join(fixed, "visit", "left").join(v, at, "left").join(a, at, "left")

    # what all texts of an hour share is worked out before them
    now = lambda h: h * hour_us + F.pmod("__off", F.lit(hour_us))
    x = x.withColumn("hours", F.transform("hours", lambda h: F.struct(h.alias("h"), now(h).alias("now"), (now(h) - trailing * hour_us).alias("low"), hour_index(F.timestamp_micros(now(h))).alias("now_h"))))

    def told(p: Column) -> Column:
        h, now, low, now_h = (p[c] for c in ("h", "now", "low", "now_h"))
        kept = F.transform("vs", lambda y: F.struct(*[y[c].alias(c) for c in label], y["units"].alias("units"), F.filter(y["e"], lambda x: (x["at"] <= now) & (x["till"] > low)).alias("k")))
        kept = F.filter(kept, lambda y: F.size(y["k"]) > 0)
        first = lambda y, c: F.when(y["units"], F.array_min(F.transform(F.filter(y["k"], lambda x: x[c].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x[c].alias("c"))))["c"])
        by_day = lambda k: E.run_text_of(F.transform(k, lambda x: F.struct(x["h"].alias("h"), x["s"].alias("s"))), F.floor(now / F.lit(24 * hour_us)).cast("bigint"))
        text = lambda y: F.when(y["section"].isin(*BY_DATE), by_day(y["k"])).otherwise(E.flagged_run_text(y["k"], now_h))
        kept = F.transform(kept, lambda y: F.struct(*[y[c].alias(c) for c in label], text(y).alias("values"), *[first(y, c).alias(c) for c in ("unit", "low", "high")]))

        def written(y: Column) -> Column:
            name, values = _labelled(*[y[c] for c in ("section", "label", "unit", "low", "high", "values")])
            return F.struct(F.filter(F.array(*[y[c] for c in label[:-1]], name), lambda x: x != "").alias("path"), values.alias("value"))

        midnight = F.floor(low / F.lit(24 * hour_us)).cast("bigint") * (24 * hour_us)
        from_h = lambda section: F.ceil(F.when(section.isin(*BY_DATE), midnight).when(section.isin(*CLOSED), low).otherwise(low + 1) / F.lit(hour_us)).cast("bigint")
        clip = lambda y: F.transform(y["e"], lambda x: F.struct(F.greatest(x["first"], from_h(y["section"])).alias("first"), F.least(x["last"], h).alias("last"), x["label"].alias("label")))
        periods = F.transform("acts", lambda y: F.struct(y["section"].alias("section"), y["path"].alias("path"), F.sort_array(F.filter(clip(y), lambda x: x["first"] <= x["last"])).alias("e")))
        ago = lambda c: (now_h - c).cast("string")
        pair = lambda x: F.concat(ago(x["first"]), F.lit("-"), ago(x["last"]))
        together = lambda e: F.array_join(F.transform(e, lambda x: F.concat(pair(x), F.lit(": "), x["label"])), ", ")
        apart = lambda e: F.array_join(F.transform(e, lambda x: F.when(x["first"] == x["last"], ago(x["first"])).otherwise(pair(x))), ",")
        active = F.transform(F.filter(periods, lambda y: F.size(y["e"]) > 0), lambda y: F.struct(y["path"].alias("path"), F.when(y["section"].isin(*TOGETHER), together(y["e"])).otherwise(apart(y["e"])).alias("value")))
        begun = F.transform(F.filter("fixed", lambda y: y["at"] <= now), lambda y: F.struct(y["path"].alias("path"), y["value"].alias("value")))
        none = F.lit([]).cast("array<struct<path: array<string>, value: string>>")
        facts = F.concat(*[F.coalesce(c, none) for c in (begun, F.transform(kept, written), active)])
        own = [] if future is None else [F.coalesce(F.try_element_at("future", tp(h)), none).alias("future")]
        return F.struct(tp(h).cast(dict(points.dtypes)["timepoint"]).alias("timepoint"), facts.alias("facts"), *own)

    return x.select("visit", F.explode(F.transform("hours", told)).alias("x")).select("visit", "x.*")


def describe_visit(history: DataFrame, points: DataFrame, trailing: int | None = 24, level: int = 0) -> DataFrame:
    """Facts ``visit, timepoint, path, value`` of what is known at each point (``visit, timepoint, t``).

    ``level``: 0 full texts of reports; 1 their impressions; 2 five values or periods; 3 the last one, and one report per kind. Values are written as
    runs, oldest first, their ages in hours (in days for what is dated by the day); activities as periods, those of locations and care takers
    of all labels together; reports and procedures by age. Labels carry their first unit and normal range. Nothing after ``t`` gets in.
    """
    keep = 5 if level == 2 else 1 if level >= 3 else None
    if keep is None and trailing is not None:
        f = known_at(history, points, trailing).select("visit", "timepoint", F.explode("facts").alias("f"))
        out = f.select("visit", "timepoint", "f.path", "f.value")
        return out.unionByName(single_entries(history, points, trailing, level))
    known = _window(history.where("kind IN ('fixed', 'active')"), points.select("visit", "timepoint", "t"), trailing)
    key = ["visit", "timepoint", "part", "sub", "section", "category", "label"]
    out = known.where("kind = 'fixed'").select("visit", "timepoint", path_of().alias("path"), F.col("text").alias("value")).where("value IS NOT NULL")
    # readings: mean of an hour's numbers, else its last text; worked out before hours meet points
    v = _window(_hourly(history.where("kind = 'value'"), ["visit"]), points.select("visit", "timepoint", "t"), trailing)
    days = F.col("section").isin(*BY_DATE)
    age = F.when(days, F.datediff("t", "hour").cast("bigint")).otherwise(hour_index("t") - hour_index("hour"))
    v = v.select(*key, (-age).alias("h"), F.lit(0).cast("bigint").alias("now"), "m", "s", "hour", "unit", "low", "high")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("hour"))).alias(c)
    unit = v.groupBy(*key).agg(first("unit"), first("low"), first("high"), F.count("m").alias("nums"), F.count(F.lit(1)).alias("n"))
    if keep is None:
        text = E.run_text(E.value_runs(v, [*key, "now"], "h", "s"), [*key, "now"], F.col("now")).drop("now")
    else:
        nums = v.join(unit.where("nums = n").select(*key), key, "left_semi")
        words = v.join(unit.where("nums < n").select(*key), key, "left_semi")
        text = E.last_with_rest(nums, key, "h", "m", F.lit(0).cast("bigint"), keep).unionByName(E.majority_with_recent(words, key, "h", "s", F.lit(0).cast("bigint"), keep))
    name, values = _labelled(*[F.col(c) for c in ("section", "label", "unit", "low", "high", "values")])
    out = out.unionByName(text.join(unit, key).select("visit", "timepoint", path_of(name).alias("path"), values.alias("value")))
    # activities: periods of each label; of locations and care takers all labels in one text
    a = known.where("kind = 'active'").select(*key, hour_index("hour").alias("h"), hour_index("t").alias("now")).distinct()
    together = F.col("section").isin(*TOGETHER)
    isl = E.islands(a, [*key, "now"], "h")
    mixed = E.interleaved_text(isl.where(together), ["visit", "timepoint", "part", "sub", "section", "category", "now"], "label", F.col("now"))
    single = E.period_text(isl.where(~together), [*key, "now"], F.col("now"), keep=keep)
    out = out.unionByName(mixed.withColumn("label", F.lit("")).select("visit", "timepoint", path_of().alias("path"), F.col("periods").alias("value")))
    out = out.unionByName(single.select("visit", "timepoint", path_of().alias("path"), F.col("periods").alias("value")))
    return out.unionByName(single_entries(history, points, trailing, level))


def single_entries(history: DataFrame, points: DataFrame, trailing: int | None, level: int) -> DataFrame:
    """Single entries as facts: procedures by days ago, reports by hours ago, cultures by test."""
    e = _window(history.where("kind = 'each'"), points.select("visit", "timepoint", "t"), trailing).withColumn("ago", hour_index("t") - hour_index("hour"))
    notes = F.col("section") == "Radiology Notes"
    said = F.when(notes, F.regexp_replace(impression(F.col("text")) if level >= 1 else F.col("text"), "\n", " ")).otherwise(F.col("text"))
    e = e.withColumn("said", said)
    if level >= 3:
        top = e.where(notes).groupBy("visit", "timepoint", "label").agg(F.max_by(F.struct("part", "sub", "section", "category", "ago", "said", "hour"), F.struct("hour", "said")).alias("x")).select("visit", "timepoint", "label", "x.*")
        e = e.where(~notes).select(*top.columns).unionByName(top)
    days_ago = F.floor(F.col("ago") / 24).cast("string")
    at = F.when(notes, F.col("ago").cast("string")).when(F.col("section") == "Procedures", F.concat(days_ago, F.lit(" days"))).otherwise(F.col("label"))
    entry = F.when(notes, F.concat("label", F.lit(": "), "said")).when(F.col("section") == "Procedures", F.col("said")).otherwise(F.concat(F.col("ago").cast("string"), F.lit(": "), "said"))
    sep = F.when(F.col("section") == "Microbiology Growth Results", ", ").otherwise("; ")
    e = e.select("visit", "timepoint", "part", "sub", "section", "category", at.alias("label"), sep.alias("sep"), F.struct("hour", entry.alias("t")).alias("x"))
    e = e.groupBy("visit", "timepoint", "part", "sub", "section", "category", "label", "sep").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "|~|").alias("value"))
    return e.select("visit", "timepoint", path_of().alias("path"), F.replace("value", F.lit("|~|"), F.col("sep")).alias("value"))


def los_facts(points: DataFrame, ends: DataFrame, mode: str = "noise", seed: str = "los") -> DataFrame:
    """The hours left of each part as facts: ``visit, timepoint, path, value``.

    ``ends``: ``visit, part, sub, begin_at, end_at``. ``noise`` (training): kept for half of the facts, times a factor in [0.8, 1.2], by hash; ``force``: the factor
    without the loss; ``exact`` (change logs). A part that is over or not begun has none; hours are whole.
    """
    left = hours_between("t", "end_at")
    p = points.join(ends, "visit").where((F.col("t") >= F.col("begin_at")) & (left >= 0)).withColumn("left", left)
    key = F.concat_ws("|", F.lit(seed), "visit", F.col("timepoint").cast("string"), "part", "sub")
    if mode == "noise":
        p = p.where(uniform(F.concat(key, F.lit("|drop"))) >= 0.5)
    hours = F.floor("left") if mode == "exact" else F.bround(F.col("left") * (F.lit(0.8) + F.lit(0.4) * uniform(key))).cast("bigint")
    return p.select("visit", "timepoint", F.filter(F.array("part", "sub", F.lit("LOS")), lambda x: x != "").alias("path"), F.concat(hours.cast("string"), F.lit(" hours")).alias("value"))

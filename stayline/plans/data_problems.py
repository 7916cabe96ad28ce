"""Queries of the data-quality operators (problems 1 and 3 to 7) over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.time import from_micros, hour_index, micros, month_index, month_start, stamp
from stayline.operators.common import attach, cut_lineage, salted_join
from stayline.operators.hot_deck import Feature, Target, hot_deck, missing_codes, number, usable
from stayline.operators.intervals import merge_intervals
from stayline.operators.packed_values import infer_delimiters, split_packed
from stayline.operators.references import count_by_period, late_references, orphan_references
from stayline.operators.regular_grid import regular_grid
from stayline.operators.spikes import Limits, flag_readings
from stayline.plans.registry import Registry, table
from stayline.plans.sql import num

R = Registry()
#: Hourly items put onto a grid.
GRID_ITEMS = (240045, 240210, 240052)
#: Plausible ranges and resolutions of the five measures; component 2 of blood pressure is diastolic. Fixed values.
OMR_LIMITS = {
    ("Blood Pressure", 1): Limits(30, 300, 1), ("Blood Pressure", 2): Limits(10, 220, 1), ("Weight (Lbs)", 1): Limits(50, 700, 0.1),
    ("Height (Inches)", 1): Limits(36, 90, 0.25), ("BMI (kg/m2)", 1): Limits(8, 110, 0.1), ("eGFR", 1): Limits(0, 200, 1),
}


# -- 1: missing values ----------------------------------------------------------------------------------------------
def reading(value: Column, valuenum: Column | None, group: str) -> tuple[Column, Column]:
    """(number, text) of a reading, both null where it holds none; the inferred ``words``, ``numbers`` and ``codes`` stand beside it."""
    x = number(value) if valuenum is None else F.coalesce(number(valuenum), number(value))
    code = F.coalesce(F.array_contains("numbers", x) & F.array_contains("codes", F.struct(F.col(group).alias("g"), x.alias("x"))), F.lit(False))
    return F.when(~code, x), F.when(x.isNull() & usable(value, F.col("words")), value)


def _read(df: DataFrame, group: str, value: str, valuenum: str | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``num`` and ``txt`` instead of the raw values, and the counts of these per group; one pass counts the raw texts."""
    raw = [c for c in (value, valuenum) if c]
    counts = cut_lineage(df.groupBy(group, *raw).agg(F.count(F.lit(1)).alias("n")))
    codes = cut_lineage(missing_codes(counts.withColumn("__t", F.coalesce(*[F.when(number(F.col(c)).isNotNull(), F.col(c)) for c in reversed(raw)], F.col(value))), group, "__t", "n"))
    num, txt = reading(F.col(value), F.col(valuenum) if valuenum else None, group)
    done = lambda d: attach(d, codes).withColumns({"num": num, "txt": txt}).drop(*raw, "words", "numbers", "codes")
    return done(df), done(counts)


def chart_fills(spark: SparkSession, sf: str) -> DataFrame:
    """chartevents rows that lack value or charttime, filled from the nearest readings of the same stay and item.

    Nearness: hours, the hour of the day, and whether the same caregiver took the reading.
    """
    c = table(spark, sf, "chartevents").select("stay_id", "itemid", "charttime", "storetime", "caregiver_id", "value", "valuenum")
    rows, counts = _read(c, "itemid", "value", "valuenum")
    hours = micros(F.coalesce("charttime", "storetime")) / 3.6e9
    delay = (micros("storetime") - micros("charttime")) / 6e7
    features = [Feature("cycle", scale=24.0, weight=0.5), Feature("category", "caregiver_id", weight=0.25)]
    return hot_deck(rows, ["stay_id", "itemid"], hours, [Target("v", "num", "txt"), Target("delay", delay)], wide=["itemid"], features=features, only_missing=True, counts={"v": counts})


def lab_fills(spark: SparkSession, sf: str) -> DataFrame:
    """Listed labs of patient_yaml without a value, filled from the same stay's nearest hours of that lab; the hour of the day counts too."""
    y = table(spark, sf, "patient_yaml").select("stay_id", "timepoint", F.explode("lab_results").alias("label", "value"))
    rows, counts = _read(y, "label", "value", None)
    return hot_deck(rows, ["stay_id", "label"], F.col("timepoint").cast("double"), [Target("v", "num", "txt")], wide=["label"], features=[Feature("cycle", scale=24.0, weight=0.5)], only_missing=True, counts={"v": counts})


# The check knows no list of words: what is no number and stands in place of one, in whatever item or lab that is measured in numbers, is no observation anywhere.
_SEEN = f"""lab AS (SELECT stay_id, timepoint, unnest(map_keys(lab_results)) AS label, unnest(map_values(lab_results)) AS value FROM patient_yaml),
seen AS (SELECT 'c' || itemid::VARCHAR AS g, value AS t, coalesce({num('valuenum')}, {num('value')}) AS x FROM chartevents UNION ALL SELECT 'l' || label, value, {num('value')} FROM lab),
grp AS (SELECT g, count(x) / count(*) > 0.8 AS measured, median(abs(x)) AS usual FROM seen GROUP BY g),
wrd AS (SELECT DISTINCT lower(trim(t)) AS w FROM seen JOIN grp USING (g) WHERE measured AND x IS NULL AND t IS NOT NULL),
cod AS (SELECT DISTINCT g, x FROM seen JOIN grp USING (g) WHERE measured AND abs(x) >= 9999 AND usual < 1000)"""
_OWN = lambda g, x, v: f"CASE WHEN NOT EXISTS (SELECT 1 FROM cod WHERE cod.g = {g} AND cod.x = {x}) THEN {x} END AS num, CASE WHEN {x} IS NULL AND regexp_matches({v}, '[\\p{{L}}\\p{{N}}]') AND lower(trim({v})) NOT IN (SELECT w FROM wrd) THEN {v} END AS txt"
_CH = f"""ch0 AS (SELECT stay_id, itemid, charttime, storetime, caregiver_id, value, 'c' || itemid::VARCHAR AS g, coalesce({num('valuenum')}, {num('value')}) AS x FROM chartevents),
ch AS (SELECT stay_id, itemid, charttime, storetime, caregiver_id, {_OWN('ch0.g', 'ch0.x', 'value')} FROM ch0)"""
_LB = f"""lb0 AS (SELECT stay_id, label, timepoint, value, 'l' || label AS g, {num('value')} AS x FROM lab), lb AS (SELECT stay_id, label, timepoint, {_OWN('lb0.g', 'lb0.x', 'value')} FROM lb0)"""


@R.add("p1_found", f"""
WITH {_SEEN}, {_CH}, {_LB}
SELECT DISTINCT 'chartevents.value' AS field_name, stay_id::VARCHAR AS stay_key, itemid::VARCHAR AS item_key, strftime(charttime, '%Y-%m-%d %H:%M:%S') AS time_key FROM ch WHERE num IS NULL AND txt IS NULL
UNION SELECT 'chartevents.charttime', stay_id::VARCHAR, itemid::VARCHAR, strftime(storetime, '%Y-%m-%d %H:%M:%S') FROM ch WHERE charttime IS NULL
UNION SELECT 'patient_yaml.lab_results', stay_id, label, timepoint::VARCHAR FROM lb WHERE num IS NULL AND txt IS NULL""")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    # every fill is made and kept, so that the optimiser can't drop the operator's work because only the marks are shown
    c, y = cut_lineage(chart_fills(spark, sf)), cut_lineage(lab_fills(spark, sf))
    key = lambda a, b, t: [F.col(a).cast("string").alias("stay_key"), F.col(b).cast("string").alias("item_key"), t.alias("time_key")]
    no_time = F.col("charttime").isNull()
    chart = c.withColumn("f", F.explode(F.filter(F.array(F.when(F.col("v_missing"), F.lit("chartevents.value")), F.when(no_time, F.lit("chartevents.charttime"))), lambda x: x.isNotNull())))
    when = F.when(F.col("f") == "chartevents.value", stamp("charttime")).otherwise(stamp("storetime"))
    labs = y.where("v_missing").select(F.lit("patient_yaml.lab_results").alias("field_name"), *key("stay_id", "label", F.col("timepoint").cast("string")))
    return chart.select(F.col("f").alias("field_name"), *key("stay_id", "itemid", when)).unionByName(labs).distinct()


def _fills_sql(rows: str, block: str, order: str, name: str, number_: str, text: str, distance: str, wide: str) -> str:
    """Tables ``name``_d (rid, donors used, number, text) and ``name``_w (wide group's number, text) by pairing every gap with every record of its block."""
    b = " AND ".join(f"d.{c} = m.{c}" for c in block.split(", "))
    return f"""{name}_o AS (SELECT *, {number_} AS dn, {text} AS dt, row_number() OVER (PARTITION BY {block} ORDER BY {order}) AS pos FROM {rows} WHERE near IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in block.split(', '))}),
{name}_p AS (SELECT m.rid, d.pos < m.pos AS before, d.near AS at, d.dn, d.dt, round({distance}, 9) AS gap, row_number() OVER (PARTITION BY m.rid, d.pos < m.pos ORDER BY abs(d.pos - m.pos)) AS k FROM {name}_o m JOIN {name}_o d ON {b} AND d.pos <> m.pos AND (d.dn IS NOT NULL OR d.dt IS NOT NULL) WHERE m.dn IS NULL AND m.dt IS NULL),
{name}_c AS (SELECT *, 1 / (1 + gap) AS w, row_number() OVER (PARTITION BY rid ORDER BY gap, k, NOT before) AS j FROM {name}_p WHERE k <= 3),
{name}_u AS (SELECT * FROM {name}_c WHERE j <= 4),
{name}_m AS (SELECT rid, min(dn) AS num FROM (SELECT rid, dn, sum(w) OVER (PARTITION BY rid ORDER BY dn, w, j) AS run, sum(w) OVER (PARTITION BY rid) AS tot FROM {name}_u WHERE dn IS NOT NULL) WHERE run * 2 >= tot - 1e-9 GROUP BY rid),
{name}_t AS (SELECT rid, dt AS txt FROM (SELECT rid, dt, row_number() OVER (PARTITION BY rid ORDER BY round(sum(w), 9) DESC, dt) AS r FROM {name}_u WHERE dt IS NOT NULL GROUP BY rid, dt) WHERE r = 1),
{name}_d AS (SELECT u.rid, u.n, m.num, t.txt FROM (SELECT rid, count(*) AS n FROM {name}_u GROUP BY rid) u LEFT JOIN {name}_m m USING (rid) LEFT JOIN {name}_t t USING (rid)),
{name}_w AS (SELECT g.{wide}, g.num, t.txt FROM (SELECT {wide}, quantile_cont({number_}, 0.5) AS num FROM {rows} GROUP BY {wide}) g LEFT JOIN (SELECT {wide}, x AS txt FROM (SELECT {wide}, {text} AS x, row_number() OVER (PARTITION BY {wide} ORDER BY count(*) DESC, {text}) AS r FROM {rows} WHERE {text} IS NOT NULL AND {number_} IS NULL GROUP BY {wide}, {text}) WHERE r = 1) t USING ({wide}))"""


_GAP = "abs(d.near - m.near)"
_DAY = "least({g} % 24, 24 - {g} % 24) / 12 * 0.5".format(g=_GAP)
_NURSE = "0.25 * coalesce((d.caregiver_id <> m.caregiver_id)::INT::DOUBLE, 0.5)"
_CHART_ROWS = "cr AS (SELECT *, row_number() OVER () AS rid, epoch_us(coalesce(charttime, storetime)) / 3.6e9 AS near, (epoch_us(storetime) - epoch_us(charttime)) / 6e7 AS delay FROM ch)"
_CHART_ORDER = "near NULLS FIRST, num NULLS FIRST, txt NULLS FIRST, delay NULLS FIRST"
_USE = lambda c, a, w: f"coalesce({a}.{c}, CASE WHEN {a}.rid IS NULL THEN {w}.{c} END)"


@R.add("p1_filled_chart", f"""WITH {_SEEN}, {_CH}, {_CHART_ROWS}, {_fills_sql('cr', 'stay_id, itemid', _CHART_ORDER, 'v', 'num', 'txt', f'{_GAP} + {_DAY} + {_NURSE}', 'itemid')}, {_fills_sql('cr', 'stay_id, itemid', _CHART_ORDER, 'l', 'delay', 'NULL::VARCHAR', f'{_GAP} + {_DAY} + {_NURSE}', 'itemid')},
f AS (SELECT cr.*, num IS NULL AND txt IS NULL AS gone, vd.rid AS vr, vd.n AS vn, CASE WHEN cr.num IS NULL AND cr.txt IS NULL THEN {_USE('num', 'vd', 'vw')} ELSE cr.num END AS n2, CASE WHEN cr.num IS NULL AND cr.txt IS NULL THEN {_USE('txt', 'vd', 'vw')} ELSE cr.txt END AS t2, {_USE('num', 'ld', 'lw')} AS lag
  FROM (SELECT * FROM cr WHERE (num IS NULL AND txt IS NULL) OR delay IS NULL) cr LEFT JOIN (SELECT rid, n, num, txt FROM v_d) vd ON vd.rid = cr.rid LEFT JOIN v_w vw ON vw.itemid = cr.itemid LEFT JOIN l_d ld ON ld.rid = cr.rid LEFT JOIN l_w lw ON lw.itemid = cr.itemid)
SELECT stay_id, itemid, strftime(coalesce(charttime, make_timestamp(epoch_us(storetime) - (lag * 6e7)::BIGINT)), '%Y-%m-%d %H:%M:%S') AS charttime, charttime IS NULL AND storetime IS NOT NULL AND lag IS NOT NULL AS charttime_filled, round(n2, 4) AS valuenum, t2 AS value, gone AND (n2 IS NOT NULL OR t2 IS NOT NULL) AS value_filled,
CASE WHEN NOT gone THEN NULL WHEN vr IS NOT NULL THEN 'block' WHEN n2 IS NOT NULL OR t2 IS NOT NULL THEN 'wide' END AS value_level, coalesce(CASE WHEN gone THEN vn END, 0)::INT AS n_donors FROM f""".replace("num IS NULL AND txt IS NULL AS gone", "cr.num IS NULL AND cr.txt IS NULL AS gone"))
def p1_filled_chart(spark: SparkSession, sf: str) -> DataFrame:
    c = chart_fills(spark, sf)
    time = F.when(F.col("delay_filled") & F.col("charttime").isNull(), from_micros(micros("storetime") - (F.col("delay_num") * 6e7).cast("bigint")))
    return c.select("stay_id", "itemid", stamp(F.coalesce("charttime", time)).alias("charttime"), time.isNotNull().alias("charttime_filled"), F.round("v_num", 4).alias("valuenum"), F.col("v_txt").alias("value"), F.col("v_filled").alias("value_filled"), F.col("v_level").alias("value_level"), F.size(F.coalesce("v_donors", F.array().cast("array<double>"))).alias("n_donors"))


@R.add("p1_filled_labs", f"""WITH {_SEEN}, {_LB}, lr AS (SELECT *, row_number() OVER () AS rid, timepoint::DOUBLE AS near FROM lb), {_fills_sql('lr', 'stay_id, label', 'near NULLS FIRST, num NULLS FIRST, txt NULLS FIRST', 'v', 'num', 'txt', f'{_GAP} + {_DAY}', 'label')}
SELECT stay_id, lr.label, timepoint, round({_USE('num', 'vd', 'vw')}, 4) AS valuenum, {_USE('txt', 'vd', 'vw')} AS value, ({_USE('num', 'vd', 'vw')} IS NOT NULL OR {_USE('txt', 'vd', 'vw')} IS NOT NULL) AS v_filled, CASE WHEN vd.rid IS NOT NULL THEN 'block' WHEN vw.num IS NOT NULL OR vw.txt IS NOT NULL THEN 'wide' END AS v_level, coalesce(vd.n, 0)::INT AS n_donors
FROM lr LEFT JOIN v_d vd ON vd.rid = lr.rid LEFT JOIN v_w vw ON vw.label = lr.label WHERE lr.num IS NULL AND lr.txt IS NULL""")
def p1_filled_labs(spark: SparkSession, sf: str) -> DataFrame:
    y = lab_fills(spark, sf).where("v_missing")
    return y.select("stay_id", "label", "timepoint", F.round("v_num", 4).alias("valuenum"), F.col("v_txt").alias("value"), "v_filled", "v_level", F.size(F.coalesce("v_donors", F.array().cast("array<double>"))).alias("n_donors"))


# -- 3: orphan references -------------------------------------------------------------------------------------------
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """tbl, row_key, ref_key, kind, month of the transfers and diagnoses whose reference has no record (yet)."""
    adm, tr = table(spark, sf, "admissions"), table(spark, sf, "transfers")
    diag, dic = table(spark, sf, "diagnoses_icd"), table(spark, sf, "d_icd_diagnoses")
    t = tr.select("transfer_id", "hadm_id", "intime").distinct()
    row = [F.lit("transfers").alias("tbl"), F.col("transfer_id").cast("string").alias("row_key"), F.col("hadm_id").cast("string").alias("ref_key")]
    month = F.date_format("intime", "yyyy-MM").alias("month")
    absent = orphan_references(t, ["hadm_id"], adm, ["hadm_id"]).select(*row, F.lit("absent").alias("kind"), month)
    later = late_references(t, "hadm_id", "intime", adm, "hadm_id", "admittime").select(*row, F.lit("later").alias("kind"), month)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    d = diag.select("hadm_id", "seq_num", trim("icd_code").alias("code"), trim("icd_version").alias("version")).distinct()
    known = dic.select(trim("icd_code").alias("code"), trim("icd_version").alias("version")).where("code IS NOT NULL")
    lost = orphan_references(d, ["version", "code"], known, ["version", "code"], required=["code"])
    began = adm.groupBy("hadm_id").agg(F.min("admittime").alias("admittime"))
    key = [F.lit("diagnoses_icd").alias("tbl"), F.concat_ws(":", F.col("hadm_id").cast("string"), F.col("seq_num").cast("string")).alias("row_key"), F.concat_ws(":", "version", "code").alias("ref_key")]
    icd = salted_join(lost, began, ["hadm_id"], "left").select(*key, F.lit("absent").alias("kind"), F.date_format("admittime", "yyyy-MM").alias("month"))
    return absent.unionByName(later).unionByName(icd).distinct()


_TRIM = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
ORPHANS_SQL = f"""
WITH t AS (SELECT DISTINCT transfer_id, hadm_id, intime FROM transfers WHERE hadm_id IS NOT NULL),
a AS (SELECT hadm_id, min(admittime) AS first_at, count(*) - count(admittime) AS open FROM admissions GROUP BY hadm_id),
d AS (SELECT DISTINCT hadm_id, seq_num, {_TRIM('icd_code')} AS code, {_TRIM('icd_version')} AS version FROM diagnoses_icd WHERE icd_code IS NOT NULL),
k AS (SELECT DISTINCT {_TRIM('icd_code')} AS code, {_TRIM('icd_version')} AS version FROM d_icd_diagnoses WHERE icd_code IS NOT NULL),
o AS (
  SELECT 'transfers' AS tbl, transfer_id::VARCHAR AS row_key, t.hadm_id::VARCHAR AS ref_key, 'absent' AS kind, strftime(intime, '%Y-%m') AS month
  FROM t WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.hadm_id = t.hadm_id)
  UNION SELECT 'transfers', transfer_id::VARCHAR, t.hadm_id::VARCHAR, 'later', strftime(intime, '%Y-%m')
  FROM t JOIN a ON a.hadm_id = t.hadm_id WHERE a.open = 0 AND a.first_at > t.intime + INTERVAL 24 HOUR
  UNION SELECT 'diagnoses_icd', concat_ws(':', d.hadm_id, d.seq_num), concat_ws(':', d.version, d.code), 'absent', strftime(a.first_at, '%Y-%m')
  FROM d LEFT JOIN a ON a.hadm_id = d.hadm_id
  WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.code = d.code AND k.version IS NOT DISTINCT FROM d.version))
"""


@R.add("p3_found", ORPHANS_SQL + "SELECT DISTINCT tbl, row_key, ref_key, kind FROM o")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(spark, sf).select("tbl", "row_key", "ref_key", "kind").distinct()


@R.add("p3_counts", ORPHANS_SQL + "SELECT tbl, kind, month, count(*) AS n_rows, count(DISTINCT ref_key) AS n_keys FROM o GROUP BY tbl, kind, month")
def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_by_period(orphans(spark, sf), ["tbl", "kind", "month"])


# -- 4: spikes ------------------------------------------------------------------------------------------------------
def omr_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """omr rows with the numbers of their text, and whether one of them is impossible; one row per component (two for blood pressure)."""
    o = table(spark, sf, "omr").select("subject_id", "chartdate", "seq_num", "result_name", "result_value")
    text = F.regexp_replace("result_value", r"([\"'])\s*([-+]?\d+),(\d+)\s*\1", "$2.$3")
    nums = F.transform(F.regexp_extract_all(text, F.lit(r"((?<![\d.])-?\d+(?:\.\d+)?)"), F.lit(1)), lambda v: v.cast("double"))
    n = o.withColumn("nums", nums).where(F.size("nums") > 0).withColumn("bad", impossible(F.col("result_name"), F.col("nums")))
    two = F.col("result_name") == "Blood Pressure"
    parts = F.posexplode(F.when(two, F.slice("nums", 1, 2)).otherwise(F.slice("nums", 1, 1)))
    return n.select("subject_id", "chartdate", "seq_num", "result_name", "bad", parts.alias("i", "x")).withColumn("component", (F.col("i") + 1).cast("int")).drop("i")


def impossible(name: Column, nums: Column) -> Column:
    """Whether any number of a text is outside its range or a diastolic isn't below its systolic; blood pressures come in pairs."""
    part = lambda k: F.filter(nums, lambda v, i: i % 2 == k - 1)
    bad = (name == "Blood Pressure") & F.exists(F.zip_with(part(1), part(2), lambda high, low: low >= high), lambda x: F.coalesce(x, F.lit(False)))
    outside = lambda lim: lambda v: (v < lim.low) | (v > lim.high)
    for (kind, component), lim in OMR_LIMITS.items():
        values = part(component) if kind == "Blood Pressure" else nums
        bad = bad | ((name == kind) & F.exists(values, outside(lim)))
    return F.coalesce(bad, F.lit(False))


def omr_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Per omr reading and component: implausible, spike, stuck, score, cutoff."""
    series = ["subject_id", "result_name", "component"]
    return flag_readings(omr_numbers(spark, sf), series, ["result_name", "component"], ["chartdate", "seq_num"], "x", OMR_LIMITS, "chartdate", bad="bad")


@R.add("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    f = omr_flags(spark, sf).where("implausible OR spike OR stuck")
    return f.select("subject_id", "result_name", F.date_format("chartdate", "yyyy-MM-dd").alias("chartdate"), F.col("seq_num").cast("int").alias("seq_num")).distinct()


@R.add("p4_flags")
def p4_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = omr_flags(spark, sf).groupBy("subject_id", "result_name", F.date_format("chartdate", "yyyy-MM-dd").alias("chartdate"), "seq_num")
    return f.agg(*[F.bool_or(x).alias(x) for x in ("implausible", "spike", "stuck")], F.round(F.max("score"), 3).alias("score"), F.round(F.max("cutoff"), 3).alias("cutoff"))


# -- 5: intervals ---------------------------------------------------------------------------------------------------
def periods(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "transfers").select(F.lit("transfers").alias("tbl"), "hadm_id", F.col("transfer_id").alias("row_id"), "intime", "outtime")
    i = table(spark, sf, "icustays").select(F.lit("icustays").alias("tbl"), "hadm_id", F.col("stay_id").alias("row_id"), "intime", "outtime")
    return merge_intervals(t.unionByName(i), ["tbl", "hadm_id"], "intime", "outtime", "row_id")


PERIODS_SQL = """
WITH r AS (
  SELECT DISTINCT 'transfers' AS tbl, hadm_id, transfer_id AS id, intime AS s, outtime AS e FROM transfers WHERE hadm_id IS NOT NULL AND outtime > intime
  UNION ALL SELECT DISTINCT 'icustays', hadm_id, stay_id, intime, outtime FROM icustays WHERE hadm_id IS NOT NULL AND outtime > intime),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY tbl, hadm_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh,
             CASE WHEN s < max(e) OVER (PARTITION BY tbl, hadm_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS over FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY tbl, hadm_id ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS island FROM f),
p AS (SELECT tbl, hadm_id, min(s) AS s, max(e) AS e, count(*) AS n, max(over) AS over FROM g GROUP BY tbl, hadm_id, island),
n AS (SELECT *, lead(s) OVER (PARTITION BY tbl, hadm_id ORDER BY s) AS nxt FROM p)
"""
_AT = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@R.add("p5_found", PERIODS_SQL + f"SELECT tbl, hadm_id, 'merged' AS kind, {_AT('s')} AS start_at, {_AT('e')} AS end_at FROM n WHERE over = 1 UNION ALL SELECT tbl, hadm_id, 'gap', {_AT('e')}, {_AT('nxt')} FROM n WHERE nxt IS NOT NULL")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    # each period gives itself, if rows overlap in it, and the gap behind it, if there is one
    row = lambda on, kind, a, z: F.when(on, F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(z).alias("z")))
    both = F.array(row(F.col("overlaps"), "merged", "start_at", "end_at"), row(F.col("next_start").isNotNull(), "gap", "end_at", "next_start"))
    each = periods(spark, sf).select("tbl", "hadm_id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x"))
    return each.select("tbl", "hadm_id", "x.kind", stamp("x.a").alias("start_at"), stamp("x.z").alias("end_at"))


@R.add("p5_periods", PERIODS_SQL + f"SELECT tbl, hadm_id, {_AT('s')} AS start_at, {_AT('e')} AS end_at, n AS n_rows, over = 1 AS overlaps FROM n")
def p5_periods(spark: SparkSession, sf: str) -> DataFrame:
    return periods(spark, sf).select("tbl", "hadm_id", stamp("start_at").alias("start_at"), stamp("end_at").alias("end_at"), "n_rows", "overlaps")


# -- 6: packed values -----------------------------------------------------------------------------------------------
@R.add("p6_found", r"""
WITH o AS (SELECT DISTINCT subject_id, result_name, chartdate, seq_num, regexp_replace(result_value, '\([^)]*\)', '', 'g') AS t FROM omr),
v AS (SELECT *, regexp_extract_all(regexp_replace(t, '["'']([0-9]+),([0-9]+)["'']', chr(1) || '\1' || chr(2) || '\2' || chr(1), 'g'), '[-+]?[0-9]+(?:[.\x02][0-9]+)?') AS vs FROM o)
SELECT DISTINCT subject_id, result_name, strftime(chartdate, '%Y-%m-%d') AS chartdate, seq_num::INT AS seq_num, i::INT AS value_pos, replace(vs[i], chr(2), ',') AS value_text FROM v, unnest(range(1, len(vs) + 1)) AS u(i) WHERE len(vs) > 1""")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "omr")
    v = split_packed(o, ["result_name"], "result_value", min_values=2)
    return v.select("subject_id", "result_name", F.date_format("chartdate", "yyyy-MM-dd").alias("chartdate"), F.col("seq_num").cast("int").alias("seq_num"), "value_pos", "value_text").distinct()


@R.add("p6_delimiters")
def p6_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    d = infer_delimiters(table(spark, sf, "omr"), ["result_name"], "result_value")
    return d.select("result_name", F.explode("scores").alias("delimiter", "score"), "delimiters").select("result_name", "delimiter", "score", F.array_contains("delimiters", F.col("delimiter")).alias("accepted"))


# -- 7: regular grids -----------------------------------------------------------------------------------------------
def chart_grid(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chartevents").where(F.col("itemid").isin(*GRID_ITEMS)).select("stay_id", "itemid", "charttime", "value", "valuenum")
    rows = c.select("stay_id", "itemid", "charttime", hour_index("charttime").alias("hour"), F.coalesce(number(F.col("valuenum")), number(F.col("value"))).alias("v"))
    return regular_grid(rows, ["stay_id", "itemid"], "hour", "v", "charttime", shard_size=24 * 14)


def visit_grid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "ed_stays").where("ed_stay_hours IS NOT NULL").select("subject_id", "intime", month_index("intime").alias("month"), F.col("ed_stay_hours").alias("v"))
    return regular_grid(e, ["subject_id"], "month", "v", "intime", shard_size=120)


HOUR_SQL = "(round_even(epoch_us(charttime) / 3600000000.0, 0))::BIGINT"
GRID_SQL = f"""
WITH c AS (SELECT stay_id, itemid, {HOUR_SQL} AS p FROM chartevents WHERE itemid IN (240045, 240210, 240052) AND charttime IS NOT NULL AND stay_id IS NOT NULL),
cl AS (SELECT DISTINCT stay_id, itemid, p FROM c),
cn AS (SELECT *, lead(p) OVER (PARTITION BY stay_id, itemid ORDER BY p) AS nxt FROM cl),
e AS (SELECT DISTINCT subject_id, (year(intime) * 12 + month(intime) - 1)::BIGINT AS p FROM ed_stays WHERE ed_stay_hours IS NOT NULL AND intime IS NOT NULL AND subject_id IS NOT NULL),
en AS (SELECT *, lead(p) OVER (PARTITION BY subject_id ORDER BY p) AS nxt FROM e),
m AS (
  SELECT 'chartevents' AS tbl, stay_id AS source_id, itemid, strftime(make_timestamp(h * 3600000000), '%Y-%m-%d %H:%M:%S') AS period_start
  FROM cn, unnest(generate_series(p + 1, nxt - 1)) AS u(h) WHERE nxt > p + 1
  UNION ALL SELECT 'ed_stays', subject_id, 0, printf('%04d-%02d-01 00:00:00', h // 12, h % 12 + 1) FROM en, unnest(generate_series(p + 1, nxt - 1)) AS u(h) WHERE nxt > p + 1)
"""


@R.add("p7_found", GRID_SQL + "SELECT tbl, source_id, itemid, period_start FROM m")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    c = chart_grid(spark, sf).where("is_missing").select(F.lit("chartevents").alias("tbl"), F.col("stay_id").alias("source_id"), "itemid", stamp(from_micros(F.col("period") * 3_600_000_000)).alias("period_start"))
    e = visit_grid(spark, sf).where("is_missing").select(F.lit("ed_stays").alias("tbl"), F.col("subject_id").alias("source_id"), F.lit(0).alias("itemid"), stamp(month_start(F.col("period"))).alias("period_start"))
    return c.unionByName(e)


def _grid_sql(source: str, keys: str, start: str) -> str:
    """Every period of a source's range with its latest value and the last one known; ``source`` gives keys, p, v, o."""
    return f"""WITH r AS ({source}), g AS (SELECT {keys}, p, arg_max(v, struct_pack(a := o, b := v)) FILTER (v IS NOT NULL) AS value, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT {keys}, unnest(range(min(p), max(p) + 1)) AS p FROM g GROUP BY {keys}), j AS (SELECT s.*, value, coalesce(n, 0) AS n_readings, n IS NULL AS is_missing FROM s LEFT JOIN g USING ({keys}, p))
SELECT {keys}, {start} AS period_start, value, last_value(value IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY p) AS filled_value, n_readings, is_missing FROM j"""


@R.add("p7_hourly", _grid_sql(f"SELECT stay_id, itemid, {HOUR_SQL} AS p, coalesce({num('valuenum')}, {num('value')}) AS v, charttime AS o FROM chartevents WHERE itemid IN (240045, 240210, 240052) AND charttime IS NOT NULL AND stay_id IS NOT NULL", "stay_id, itemid", "strftime(make_timestamp(p * 3600000000), '%Y-%m-%d %H:%M:%S')"))
def p7_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return chart_grid(spark, sf).select("stay_id", "itemid", stamp(from_micros(F.col("period") * 3_600_000_000)).alias("period_start"), "value", "filled_value", "n_readings", "is_missing")


@R.add("p7_monthly", _grid_sql("SELECT subject_id, (year(intime) * 12 + month(intime) - 1)::BIGINT AS p, ed_stay_hours AS v, intime AS o FROM ed_stays WHERE ed_stay_hours IS NOT NULL AND intime IS NOT NULL AND subject_id IS NOT NULL", "subject_id", "printf('%04d-%02d-01 00:00:00', p // 12, p % 12 + 1)"))
def p7_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return visit_grid(spark, sf).select("subject_id", stamp(month_start(F.col("period"))).alias("period_start"), "value", "filled_value", "n_readings", "is_missing")

"""Window, encoder, snapshot and change-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.functions.hashing import uniform, uniform_sql
from stayline.functions.numeric import text_of
from stayline.functions.time import hour_index, hour_round, hours_between, micros, stamp
from stayline.operators import aggregates as A
from stayline.operators import encode as E
from stayline.operators import snapshot as N
from stayline.operators.joins import latest_per_key
from stayline.plans.catalogue_joins import readings
from stayline.plans.registry import Registry, table
from stayline.plans.sql import READINGS, at, hour, num
from stayline.plans.sql import text_of as text_sql

R = Registry()
DF, S = DataFrame, SparkSession


@R.add("lead_interval_end", f"WITH t AS (SELECT DISTINCT hadm_id, transfer_id, intime FROM transfers WHERE hadm_id IS NOT NULL AND intime IS NOT NULL), a AS (SELECT hadm_id, max(dischtime) AS d FROM admissions GROUP BY hadm_id) SELECT t.hadm_id, transfer_id, {at('coalesce(lead(intime) OVER (PARTITION BY t.hadm_id ORDER BY intime, transfer_id), a.d)')} AS end_at FROM t LEFT JOIN a ON a.hadm_id = t.hadm_id")
def lead_interval_end(s: S, sf: str) -> DF:
    t = table(s, sf, "transfers").where("hadm_id IS NOT NULL AND intime IS NOT NULL").select("hadm_id", "transfer_id", "intime").distinct()
    a = table(s, sf, "admissions").groupBy("hadm_id").agg(F.max("dischtime").alias("d"))
    return E.interval_ends(t.join(a, "hadm_id", "left"), ["hadm_id"], "intime", "transfer_id", F.col("d")).select("hadm_id", "transfer_id", stamp("end_at").alias("end_at"))


_H = "(round_even(epoch_us({c}) / 3600000000.0, 0))::BIGINT"
_ISL = f"""WITH o AS (SELECT DISTINCT stay_id, itemid, {_H.format(c='charttime')} AS h FROM chartevents WHERE charttime IS NOT NULL AND stay_id IS NOT NULL AND itemid IS NOT NULL),
m AS (SELECT stay_id, max(h) AS now FROM o GROUP BY stay_id),
i AS (SELECT stay_id, itemid, min(h) AS first, max(h) AS last FROM (SELECT *, h - row_number() OVER (PARTITION BY stay_id, itemid ORDER BY h) AS g FROM o) GROUP BY stay_id, itemid, g),
s AS (SELECT i.*, now, CASE WHEN first = last THEN (now - first)::VARCHAR ELSE (now - first)::VARCHAR || '-' || (now - last)::VARCHAR END AS t, row_number() OVER (PARTITION BY i.stay_id, itemid ORDER BY first DESC) AS rd, count(*) OVER (PARTITION BY i.stay_id, itemid) AS n FROM i JOIN m ON m.stay_id = i.stay_id)"""


def _islands(s: S, sf: str) -> DF:
    o = table(s, sf, "chartevents").where("charttime IS NOT NULL AND stay_id IS NOT NULL AND itemid IS NOT NULL").select("stay_id", "itemid", hour_index("charttime").alias("h"))
    now = o.groupBy("stay_id").agg(F.max("h").alias("now"))
    return E.islands(o, ["stay_id", "itemid"], "h").join(now, "stay_id")


@R.add("gaps_islands_periods", _ISL + " SELECT stay_id, itemid, string_agg(t, ',' ORDER BY first) AS periods, count(*) AS n FROM s GROUP BY stay_id, itemid")
def gaps_islands_periods(s: S, sf: str) -> DF:
    return E.period_text(_islands(s, sf), ["stay_id", "itemid"], F.col("now")).withColumn("n", F.col("n").cast("bigint"))


@R.add("restricted_periods", _ISL + " SELECT stay_id, itemid, CASE WHEN max(n) > 4 THEN (max(n) - 1)::VARCHAR || 'x in past, current: ' || max(t) FILTER (rd = 1) ELSE string_agg(t, ',' ORDER BY first) END AS periods FROM s GROUP BY stay_id, itemid")
def restricted_periods(s: S, sf: str) -> DF:
    return E.period_text(_islands(s, sf), ["stay_id", "itemid"], F.col("now"), keep=1).drop("n")


@R.add("interleaved_periods", _ISL + " SELECT stay_id, string_agg((now - first)::VARCHAR || '-' || (now - last)::VARCHAR || ': ' || itemid::VARCHAR, ', ' ORDER BY first, last, itemid) AS periods FROM s GROUP BY stay_id")
def interleaved_periods(s: S, sf: str) -> DF:
    return E.interleaved_text(_islands(s, sf).withColumn("label", F.col("itemid").cast("string")), ["stay_id"], "label", F.col("now"))


_HV = f"WITH {READINGS}, h AS (SELECT stay_id, itemid, hour, {_H.format(c='hour')} AS h, round(avg(v), 6) AS v FROM readings WHERE v IS NOT NULL AND itemid IS NOT NULL GROUP BY stay_id, itemid, hour), m AS (SELECT *, max(h) OVER (PARTITION BY stay_id) AS now, {text_sql('v')} AS t, row_number() OVER (PARTITION BY stay_id, itemid ORDER BY h DESC) AS rd, count(*) OVER (PARTITION BY stay_id, itemid) AS n FROM h)"


def _hourly(s: S, sf: str) -> DF:
    h = readings(s, sf).where("v IS NOT NULL AND itemid IS NOT NULL").groupBy("stay_id", "itemid", "hour").agg(F.round(F.avg("v"), 6).alias("v")).withColumn("h", hour_index("hour")).withColumn("t", text_of(F.col("v")))
    return h.join(h.groupBy("stay_id").agg(F.max("h").alias("now")), "stay_id")


@R.add("value_runs", _HV + """, f AS (SELECT *, rd <= 5 AS recent, CASE WHEN lag(t) OVER w = t AND (lag(rd) OVER w <= 5) = (rd <= 5) THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY stay_id, itemid ORDER BY h)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY stay_id, itemid ORDER BY h) AS run FROM f),
g AS (SELECT stay_id, itemid, run, any_value(t) AS t, any_value(recent) AS recent, min(h) AS a, max(h) AS b, any_value(now) AS now, string_agg((now - h)::VARCHAR, '/' ORDER BY h) AS hs FROM r GROUP BY stay_id, itemid, run)
SELECT stay_id, itemid, string_agg(CASE WHEN recent THEN hs WHEN a = b THEN (now - a)::VARCHAR ELSE (now - a)::VARCHAR || '-' || (now - b)::VARCHAR END || ': ' || t, ', ' ORDER BY run) AS "values" FROM g GROUP BY stay_id, itemid""")
def value_runs(s: S, sf: str) -> DF:
    h = _hourly(s, sf)
    runs = E.value_runs(h, ["stay_id", "itemid", "now"], "h", "t")
    return E.run_text(runs, ["stay_id", "itemid", "now"], F.col("now")).drop("now")


@R.add("last_n_with_rest", _HV + f""" SELECT stay_id, itemid, CASE WHEN max(n) > 4 THEN 'past: ' || {text_sql('max(v) FILTER (rd > 1)')} || '-' || {text_sql('min(v) FILTER (rd > 1)')} || ', mean: ' || {text_sql('round(avg(v) FILTER (rd > 1), 6)')} || ', recent: ' || max((now - h)::VARCHAR || ': ' || t) FILTER (rd = 1) ELSE string_agg((now - h)::VARCHAR || ': ' || t, ', ' ORDER BY h) END AS "values" FROM m GROUP BY stay_id, itemid""")
def last_n_with_rest(s: S, sf: str) -> DF:
    return E.last_with_rest(_hourly(s, sf), ["stay_id", "itemid"], "h", "v", F.col("now"), 1)


@R.add("majority_with_recent", f"""WITH w AS (SELECT stay_id, itemid, {_H.format(c='charttime')} AS h, max(value) AS v FROM chartevents WHERE value IS NOT NULL AND valuenum IS NULL AND charttime IS NOT NULL AND stay_id IS NOT NULL AND itemid IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT *, max(h) OVER (PARTITION BY stay_id) AS now, row_number() OVER (PARTITION BY stay_id, itemid ORDER BY h DESC) AS rd, count(*) OVER (PARTITION BY stay_id, itemid) AS n FROM w),
c AS (SELECT stay_id, itemid, trim(v) AS v, row_number() OVER (PARTITION BY stay_id, itemid ORDER BY count(*) DESC, trim(v)) AS k FROM m WHERE rd > 1 GROUP BY stay_id, itemid, trim(v))
SELECT m.stay_id, m.itemid, CASE WHEN max(n) > 4 THEN 'past: majority: ' || max(trim(c.v)) || ', recent: ' || max((now - h)::VARCHAR || ': ' || trim(m.v)) FILTER (rd = 1) ELSE string_agg((now - h)::VARCHAR || ': ' || trim(m.v), ', ' ORDER BY h) END AS "values"
FROM m LEFT JOIN c ON c.stay_id = m.stay_id AND c.itemid = m.itemid AND c.k = 1 GROUP BY m.stay_id, m.itemid""")
def majority_with_recent(s: S, sf: str) -> DF:
    w = table(s, sf, "chartevents").where("value IS NOT NULL AND valuenum IS NULL AND charttime IS NOT NULL AND stay_id IS NOT NULL AND itemid IS NOT NULL").groupBy("stay_id", "itemid", hour_index("charttime").alias("h")).agg(F.max("value").alias("v"))
    w = w.join(w.groupBy("stay_id").agg(F.max("h").alias("now")), "stay_id")
    return E.majority_with_recent(w.withColumn("h", F.col("h") - F.col("now")), ["stay_id", "itemid"], "h", "v", F.lit(0).cast("bigint"), 1)


@R.add("first_unit", f"SELECT stay_id, itemid, arg_min(valueuom, struct_pack(a := charttime, b := valueuom)) FILTER (valueuom IS NOT NULL) AS unit FROM chartevents WHERE charttime IS NOT NULL AND stay_id IS NOT NULL GROUP BY stay_id, itemid")
def first_unit(s: S, sf: str) -> DF:
    c = table(s, sf, "chartevents").where("charttime IS NOT NULL AND stay_id IS NOT NULL")
    return c.groupBy("stay_id", "itemid").agg(A.first_known(F.col("valueuom"), F.col("charttime"), F.col("valueuom")).alias("unit"))


@R.add("latest_per_modality", f"SELECT hadm_id, source, doc_id, {at('charttime')} AS charttime FROM (SELECT hadm_id, lower(trim(source)) AS source, doc_id, charttime, row_number() OVER (PARTITION BY hadm_id, lower(trim(source)) ORDER BY charttime DESC, doc_id DESC) AS rn FROM documents WHERE hadm_id IS NOT NULL AND charttime IS NOT NULL AND source IS NOT NULL) WHERE rn = 1")
def latest_per_modality(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").where("hadm_id IS NOT NULL AND source IS NOT NULL").select("hadm_id", F.lower(F.trim("source")).alias("source"), "doc_id", "charttime")
    return latest_per_key(d, ["hadm_id", "source"], "charttime", "doc_id").withColumn("charttime", stamp("charttime"))


@R.add("days_ago_text", "WITH o AS (SELECT subject_id, result_name, chartdate, min(result_value) AS v FROM omr WHERE result_value IS NOT NULL AND chartdate IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT *, max(chartdate) OVER (PARTITION BY subject_id) AS now FROM o) SELECT subject_id, result_name, string_agg(date_diff('day', chartdate, now)::VARCHAR || ' days: ' || v, ', ' ORDER BY chartdate) AS v FROM m GROUP BY subject_id, result_name")
def days_ago_text(s: S, sf: str) -> DF:
    o = table(s, sf, "omr").where("result_value IS NOT NULL AND chartdate IS NOT NULL").groupBy("subject_id", "result_name", "chartdate").agg(F.min("result_value").alias("v"))
    m = o.join(o.groupBy("subject_id").agg(F.max("chartdate").alias("now")), "subject_id")
    t = F.concat(F.datediff("now", "chartdate").cast("string"), F.lit(" days: "), F.col("v"))
    return m.groupBy("subject_id", "result_name").agg(A.ordered_text(t, F.col("chartdate"), ", ").alias("v"))


# -- grid and snapshots -------------------------------------------------------------------------------------------------
@R.add("hour_grid_expand", f"""WITH i AS (SELECT DISTINCT hadm_id, stay_id, coalesce(intime, outtime - INTERVAL 1 HOUR) AS a, coalesce(outtime, intime + INTERVAL 1 HOUR) AS b, first_careunit FROM icustays)
SELECT stay_id, {at('h')} AS hour, max(first_careunit) AS unit FROM (SELECT stay_id, first_careunit, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b + INTERVAL 3599999999 MICROSECOND), INTERVAL 1 HOUR)) AS h FROM i WHERE b >= a) GROUP BY stay_id, h""")
def hour_grid_expand(s: S, sf: str) -> DF:
    i = table(s, sf, "icustays").select("hadm_id", "stay_id", "intime", "outtime", "first_careunit").distinct()
    g = N.last_writer(N.hour_expand(i, "intime", "outtime"), ["stay_id"], "first_careunit", ["first_careunit"])
    return g.select("stay_id", stamp("hour").alias("hour"), F.col("first_careunit").alias("unit"))


@R.add("build_stays", """WITH a AS (SELECT DISTINCT subject_id, hadm_id, admittime, dischtime FROM admissions),
i AS (SELECT hadm_id, string_agg(stay_id::VARCHAR, ',' ORDER BY stay_id) AS icu FROM (SELECT DISTINCT hadm_id, stay_id FROM icustays WHERE hadm_id IS NOT NULL) GROUP BY hadm_id),
e AS (SELECT hadm_id, stay_id, ed_stay_hours FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY intime DESC NULLS LAST, stay_id DESC) AS rn FROM ed_stays WHERE hadm_id IS NOT NULL) WHERE rn = 1)
SELECT concat_ws('_', a.subject_id, a.hadm_id) AS stay_id, coalesce(i.icu, '') AS icu, e.stay_id::VARCHAR AS ed_stay_id, coalesce(e.ed_stay_hours, 0.0) AS ed_stay_hours, round(epoch(dischtime - admittime) / 3600.0, 2) AS hosp_stay_hours FROM a LEFT JOIN i ON i.hadm_id = a.hadm_id LEFT JOIN e ON e.hadm_id = a.hadm_id
UNION ALL SELECT * FROM (SELECT DISTINCT concat_ws('_', subject_id, stay_id), '', stay_id::VARCHAR, ed_stay_hours, NULL::DOUBLE FROM ed_stays WHERE hadm_id IS NULL)""")
def build_stays(s: S, sf: str) -> DF:
    b = N.build_stays(table(s, sf, "admissions"), table(s, sf, "icustays"), table(s, sf, "ed_stays"))
    return b.select("stay_id", F.array_join(F.transform("icu_stay_ids", lambda x: x.cast("string")), ",").alias("icu"), F.col("ed_stay_id").cast("string").alias("ed_stay_id"), "ed_stay_hours", F.round("hosp_stay_hours", 2).alias("hosp_stay_hours"))


@R.add("stay_segments", "SELECT DISTINCT subject_id, hadm_id::VARCHAR AS hadm_id, hadm_id AS segment_id, 'admission' AS stay_type, round(epoch(dischtime - admittime) / 3600.0, 3) AS hours FROM admissions UNION ALL SELECT DISTINCT subject_id, hadm_id::VARCHAR, stay_id, 'icu', round(epoch(outtime - intime) / 3600.0, 3) FROM icustays UNION ALL SELECT DISTINCT subject_id, hadm_id::VARCHAR, stay_id, 'ed', round(epoch(outtime - intime) / 3600.0, 3) FROM ed_stays")
def stay_segments(s: S, sf: str) -> DF:
    g = N.segments(table(s, sf, "admissions"), table(s, sf, "icustays"), table(s, sf, "ed_stays"))
    return g.select("subject_id", F.col("hadm_id").cast("string").alias("hadm_id"), "segment_id", "stay_type", F.round("hours", 3).alias("hours")).distinct()


def _points(s: S, sf: str) -> DF:
    """Every hour of an ICU stay from its first to its last reading, as t."""
    r = readings(s, sf)
    b = r.groupBy("stay_id").agg(F.min("hour").alias("a"), F.max("hour").alias("z"))
    return b.select("stay_id", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 HOUR"))).alias("t"))


_PTS = f"WITH {READINGS}, pts AS (SELECT stay_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS t FROM readings GROUP BY stay_id)"


@R.add("trailing_24h", _PTS + f" SELECT p.stay_id, {at('p.t')} AS t, r.itemid, count(*) AS n, round(round(avg(v), 9), 4) AS mean FROM pts p JOIN readings r ON r.stay_id = p.stay_id AND r.hour <= p.t AND r.hour > p.t - INTERVAL 24 HOUR WHERE v IS NOT NULL GROUP BY p.stay_id, p.t, r.itemid")
def trailing_24h(s: S, sf: str) -> DF:
    e = readings(s, sf).where("v IS NOT NULL").select("stay_id", "itemid", "hour", "v")
    u = N.until(e, _points(s, sf), ["stay_id"], "hour", trailing_hours=24)
    return u.groupBy("stay_id", "t", "itemid").agg(F.count(F.lit(1)).alias("n"), F.round(F.round(F.avg("v"), 9), 4).alias("mean")).withColumn("t", stamp("t"))  # rounded twice: the first takes off what the order of summation leaves


@R.add("as_of_snapshot", f"WITH {READINGS}, p AS (SELECT stay_id, max(hour) - INTERVAL 24 HOUR AS t FROM readings GROUP BY stay_id) SELECT p.stay_id, itemid, count(*) AS n, round(arg_max(v, struct_pack(a := charttime, b := v)), 4) AS last FROM p JOIN readings r ON r.stay_id = p.stay_id AND r.hour <= p.t WHERE v IS NOT NULL GROUP BY p.stay_id, itemid")
def as_of_snapshot(s: S, sf: str) -> DF:
    r = readings(s, sf)
    p = r.groupBy("stay_id").agg((F.max("hour") - F.expr("INTERVAL 24 HOURS")).alias("t"))
    u = N.until(r.where("v IS NOT NULL"), p, ["stay_id"], "hour")
    return u.groupBy("stay_id", "itemid").agg(F.count(F.lit(1)).alias("n"), F.round(F.max_by("v", F.struct("charttime", "v")), 4).alias("last"))


@R.add("trailing_dates", "WITH p AS (SELECT subject_id, max(chartdate) + INTERVAL 6 HOUR AS t FROM omr GROUP BY subject_id) SELECT p.subject_id, result_name, count(*) AS n FROM p JOIN omr o ON o.subject_id = p.subject_id AND o.chartdate <= p.t AND o.chartdate::DATE >= (p.t - INTERVAL 720 HOUR)::DATE GROUP BY p.subject_id, result_name")
def trailing_dates(s: S, sf: str) -> DF:
    o = table(s, sf, "omr").select("subject_id", "chartdate", "result_name")
    p = o.groupBy("subject_id").agg((F.max("chartdate") + F.expr("INTERVAL 6 HOURS")).alias("t"))
    return N.until(o, p, ["subject_id"], "chartdate", trailing_hours=720, by_date=True).groupBy("subject_id", "result_name").agg(F.count(F.lit(1)).alias("n"))


@R.add("exact_hour", _PTS + f" SELECT p.stay_id, {at('p.t')} AS t, r.itemid, count(*) AS n FROM pts p JOIN readings r ON r.stay_id = p.stay_id AND r.hour = p.t GROUP BY p.stay_id, p.t, r.itemid")
def exact_hour(s: S, sf: str) -> DF:
    e = readings(s, sf).select("stay_id", "itemid", "hour")
    return N.exactly(e, _points(s, sf), ["stay_id"], "hour").groupBy("stay_id", "t", "itemid").agg(F.count(F.lit(1)).alias("n")).withColumn("t", stamp("t"))


# -- change log ---------------------------------------------------------------------------------------------------------
_TP = "WITH st AS (SELECT DISTINCT stay_id, patient_id, hosp_stay_hours AS hh, ed_stay_hours AS eh FROM stay_to_ids_dict WHERE hosp_stay_hours IS NOT NULL), tp AS (SELECT stay_id, hh, eh, unnest(range(0, greatest(floor(hh)::BIGINT, 0) + 2)) AS timepoint FROM st)"


@R.add("timepoints_grid", _TP + " SELECT stay_id, timepoint, timepoint - 1 AS hour_idx, CASE WHEN eh > 0 THEN timepoint - 1 - (eh + 2) ELSE timepoint - 1 END::DOUBLE AS hosp_hour FROM tp")
def timepoints_grid(s: S, sf: str) -> DF:
    st = table(s, sf, "stay_to_ids_dict").where("hosp_stay_hours IS NOT NULL").select("stay_id", "patient_id", "hosp_stay_hours", "ed_stay_hours").distinct()
    p = N.timepoints(st.withColumn("start", F.lit("2150-01-01 00:00:00").cast("timestamp_ntz")), "start", F.col("hosp_stay_hours"))
    return p.select("stay_id", F.col("timepoint").cast("bigint").alias("timepoint"), F.col("hour_idx").cast("bigint").alias("hour_idx"), N.hospital_hour(F.col("hour_idx"), F.col("ed_stay_hours")).cast("double").alias("hosp_hour"))


@R.add("next_hour_facts", f"WITH {READINGS} SELECT stay_id, {at('hour - INTERVAL 1 HOUR')} AS t, 'ICU.' || itemid::VARCHAR AS path, CASE WHEN count(v) > 0 THEN {text_sql('round(avg(v), 6)')} ELSE max(value) END AS value FROM readings GROUP BY stay_id, hour, itemid")
def next_hour_facts(s: S, sf: str) -> DF:
    """What the next hour brings, as facts under the hour before it."""
    g = readings(s, sf).groupBy("stay_id", "hour", "itemid").agg(F.avg("v").alias("m"), F.max("value").alias("x"))
    return g.select("stay_id", stamp(F.col("hour") - F.expr("INTERVAL 1 HOUR")).alias("t"), F.concat(F.lit("ICU."), F.col("itemid").cast("string")).alias("path"), F.coalesce(text_of(F.round("m", 6)), "x").alias("value"))


@R.add("flatten_paths", "SELECT stay_id, timepoint, 'Hospital Stay.Lab Results.' || k AS path, lab_results[k] AS value FROM (SELECT stay_id, timepoint, lab_results, unnest(map_keys(lab_results)) AS k FROM patient_yaml)")
def flatten_paths(s: S, sf: str) -> DF:
    y = table(s, sf, "patient_yaml").select("stay_id", "timepoint", F.explode("lab_results").alias("k", "value"))
    return y.select("stay_id", "timepoint", F.concat_ws(".", F.array(F.lit("Hospital Stay"), F.lit("Lab Results"), F.col("k"))).alias("path"), "value")


@R.add("end_of_stay_cases", "SELECT DISTINCT hadm_id, subject_id, CASE WHEN hospital_expire_flag = 1 OR deathtime IS NOT NULL THEN 'DIED' WHEN dischtime IS NULL THEN 'OPEN' ELSE 'DISCHARGED' END AS hospital_end FROM admissions")
def end_of_stay_cases(s: S, sf: str) -> DF:
    end = F.when((F.col("hospital_expire_flag") == 1) | F.col("deathtime").isNotNull(), "DIED").when(F.col("dischtime").isNull(), "OPEN").otherwise("DISCHARGED")
    return table(s, sf, "admissions").select("hadm_id", "subject_id", end.alias("hospital_end")).distinct()


@R.add("ed_end_cases", "SELECT DISTINCT stay_id, CASE WHEN disposition = 'EXPIRED' THEN 'DIED' WHEN disposition = 'ADMITTED' OR hadm_id IS NOT NULL THEN 'ADMITTED' ELSE 'DISCHARGED' END AS ed_end FROM ed_stays")
def ed_end_cases(s: S, sf: str) -> DF:
    end = F.when(F.col("disposition") == "EXPIRED", "DIED").when((F.col("disposition") == "ADMITTED") | F.col("hadm_id").isNotNull(), "ADMITTED").otherwise("DISCHARGED")
    return table(s, sf, "ed_stays").select("stay_id", end.alias("ed_end")).distinct()


@R.add("los_hours", "SELECT DISTINCT stay_id, CAST(floor(epoch(outtime - intime) / 3600.0) AS BIGINT) AS hours FROM icustays WHERE outtime > intime")
def los_hours(s: S, sf: str) -> DF:
    i = table(s, sf, "icustays").where("outtime > intime")
    return i.select("stay_id", F.floor(hours_between("intime", "outtime")).alias("hours")).distinct()


@R.add("los_noise_hash", f"SELECT DISTINCT stay_id, CASE WHEN {uniform_sql('''stay_id || '|drop' ''')} < 0.5 THEN NULL ELSE round(hosp_stay_hours * (0.8 + 0.4 * {uniform_sql('''stay_id || '|los' ''')}), 3) END AS los FROM stay_to_ids_dict WHERE hosp_stay_hours IS NOT NULL")
def los_noise_hash(s: S, sf: str) -> DF:
    """A hidden or blurred length of stay: dropped for half of the stays, else times a factor in [0.8, 1.2], by hash."""
    d = table(s, sf, "stay_to_ids_dict").where("hosp_stay_hours IS NOT NULL").select("stay_id", "hosp_stay_hours").distinct()
    drop, f = uniform(F.concat("stay_id", F.lit("|drop"))), uniform(F.concat("stay_id", F.lit("|los")))
    return d.select("stay_id", F.when(drop >= 0.5, F.round(F.col("hosp_stay_hours") * (0.8 + 0.4 * f), 3)).alias("los"))


@R.add("state_append", "SELECT tbl, count(*) AS n, count(careunit) AS units, count(disposition) AS dispositions FROM (SELECT 'transfers' AS tbl, careunit, NULL AS disposition FROM transfers UNION ALL SELECT 'ed', NULL, disposition FROM ed_stays) GROUP BY tbl")
def state_append(s: S, sf: str) -> DF:
    """New rows appended to a state that lacks some of their columns."""
    t = table(s, sf, "transfers").select(F.lit("transfers").alias("tbl"), "hadm_id", "intime", "careunit")
    e = table(s, sf, "ed_stays").select(F.lit("ed").alias("tbl"), "hadm_id", "intime", "disposition")
    return t.unionByName(e, allowMissingColumns=True).groupBy("tbl").agg(F.count(F.lit(1)).alias("n"), F.count("careunit").alias("units"), F.count("disposition").alias("dispositions"))

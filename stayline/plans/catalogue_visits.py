"""Whole visits: histories, descriptions, change logs, sections, weights and task samples over the tables of stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.functions.icd import CHAPTERS, icd_chapter, icd_chapter_sql
from stayline.functions.time import hour_round, stamp
from stayline.operators import changes as C
from stayline.operators import evaluation as Z
from stayline.operators import sections as G
from stayline.operators import tasks as K
from stayline.operators import visits as V
from stayline.operators.common import cut_lineage
from stayline.operators.simulate import simulate_visits
from stayline.plans.registry import Registry, table
from stayline.plans.sql import at, hour, num
from stayline.plans.sql import text_of as text_sql

R = Registry()
DF, S = DataFrame, SparkSession


# -- the frames that the queries share, in both languages -------------------------------------------------------------------
def core(s: S, sf: str) -> DF:
    """Admissions, one row each: visit, subject_id, hadm_id, admittime, dischtime, start, the words of ``General`` and how they ended."""
    a = table(s, sf, "admissions").where("subject_id IS NOT NULL AND hadm_id IS NOT NULL")
    g = a.groupBy("subject_id", "hadm_id").agg(F.min("admittime").alias("admittime"), F.max("dischtime").alias("dischtime"), *[F.min(c).alias(c) for c in ("admission_type", "insurance", "race", "language", "discharge_location")])
    return g.withColumn("visit", F.concat_ws("_", "subject_id", "hadm_id")).withColumn("start", hour_round("admittime"))


def ed_core(s: S, sf: str) -> DF:
    """Emergency stays with their visit: the latest of an admission's, and those without admission."""
    e = table(s, sf, "ed_stays").where("stay_id IS NOT NULL")
    row = F.struct("stay_id", "intime", "outtime", "gender", "race", "arrival_transport", "disposition")
    own = e.where("hadm_id IS NOT NULL AND subject_id IS NOT NULL AND intime IS NOT NULL").groupBy("subject_id", "hadm_id").agg(F.max_by(row, F.struct("intime", "stay_id")).alias("e")).select(F.concat_ws("_", "subject_id", "hadm_id").alias("visit"), "e.*")
    lone = e.where("hadm_id IS NULL AND subject_id IS NOT NULL AND intime IS NOT NULL").groupBy("subject_id", "stay_id").agg(F.max_by(row, F.struct("intime", "stay_id")).alias("e")).select(F.concat_ws("_", "subject_id", "stay_id").alias("visit"), "e.*")
    return own.unionByName(lone)


def icu_core(s: S, sf: str) -> DF:
    """ICU stays of the admissions, numbered within each by their beginning: visit, subject_id, hadm_id, stay_id, intime, outtime, sub."""
    i = table(s, sf, "icustays").where("subject_id IS NOT NULL AND hadm_id IS NOT NULL AND stay_id IS NOT NULL AND intime IS NOT NULL")
    i = i.groupBy("subject_id", "hadm_id", "stay_id").agg(F.min("intime").alias("intime"), F.max("outtime").alias("outtime"))
    n = F.row_number().over(Window.partitionBy("subject_id", "hadm_id").orderBy("intime", "stay_id")) - 1
    return i.withColumn("visit", F.concat_ws("_", "subject_id", "hadm_id")).withColumn("sub", F.concat(F.lit("Stay "), n.cast("string"))).join(core(s, sf).select("visit"), "visit", "left_semi")


def points(s: S, sf: str) -> DF:
    v = core(s, sf).select("visit", F.col("admittime").alias("adm_in"), F.col("dischtime").alias("adm_out")).join(ed_core(s, sf).select("visit", F.col("intime").alias("ed_in"), F.col("outtime").alias("ed_out")), "visit", "full_outer")
    return C.with_next(V.visit_points(cut_lineage(v).repartition("visit")))  # hours are made anew, visit by visit, wherever they are read: written down they take more than all tables


def history(s: S, sf: str) -> DF:
    """Hospital, ICU and emergency parts of all visits from the tables that are there."""
    tables = {n: table(s, sf, n) for n in ("transfers", "omr", "chartevents")} | {"labs": table(s, sf, "patient_yaml")}
    adm = V.build_admission(core(s, sf), {k: tables[k] for k in ("transfers", "omr", "labs")})
    return adm.unionByName(V.build_icu(icu_core(s, sf), {"chartevents": tables["chartevents"].drop("subject_id", "hadm_id")})).unionByName(V.build_ed(ed_core(s, sf), {}))


_CORE = f"""co AS (SELECT subject_id, hadm_id, concat_ws('_', subject_id, hadm_id) AS visit, min(admittime) AS admittime, max(dischtime) AS dischtime, {hour('min(admittime)')} AS start, min(admission_type) AS admission_type, min(insurance) AS insurance, min(race) AS race, min(language) AS language, min(discharge_location) AS discharge_location
  FROM admissions WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL GROUP BY subject_id, hadm_id)"""
_EDC = """ed AS (SELECT concat_ws('_', subject_id, coalesce(hadm_id, stay_id)) AS visit, stay_id, intime, outtime, gender, race, arrival_transport, disposition FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id, hadm_id, CASE WHEN hadm_id IS NULL THEN stay_id END ORDER BY intime DESC, stay_id DESC) AS rn FROM ed_stays WHERE stay_id IS NOT NULL AND subject_id IS NOT NULL AND intime IS NOT NULL) WHERE rn = 1)"""
_ICU = """iu AS (SELECT visit, stay_id, intime, outtime, 'Stay ' || (row_number() OVER (PARTITION BY visit ORDER BY intime, stay_id) - 1)::VARCHAR AS sub FROM (
  SELECT concat_ws('_', subject_id, hadm_id) AS visit, stay_id, min(intime) AS intime, max(outtime) AS outtime FROM icustays WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL AND stay_id IS NOT NULL AND intime IS NOT NULL GROUP BY subject_id, hadm_id, stay_id)
  WHERE visit IN (SELECT visit FROM co))"""
_SPAN = lambda a, b: f"greatest(floor(coalesce((epoch_us({hour(b)}) - epoch_us({hour(a)})) / 3.6e9, 0)), 0)::INT"
_POINTS = f"""{_CORE}, {_EDC}, vs AS (SELECT coalesce(co.visit, ed.visit) AS visit, ed.intime AS ed_in, admittime AS adm_in, CASE WHEN ed.intime IS NOT NULL THEN {_SPAN('ed.intime', 'ed.outtime')} END AS e, CASE WHEN admittime IS NOT NULL THEN {_SPAN('admittime', 'dischtime')} END AS h FROM co FULL JOIN ed ON ed.visit = co.visit),
v2 AS (SELECT *, ed_in IS NOT NULL AND e > 0 AS has_ed, CASE WHEN ed_in IS NOT NULL AND e > 0 THEN e + 2 ELSE 0 END AS first FROM vs),
v3 AS (SELECT *, unnest(range(-1, coalesce(first + h, e) + 1))::INT AS hour_idx FROM v2 WHERE coalesce(first + h, e) IS NOT NULL),
pt AS (SELECT visit, hour_idx + 1 AS timepoint, hour_idx, CASE WHEN has_ed AND hour_idx <= e THEN 'ed' WHEN has_ed AND hour_idx = e + 1 THEN 'admitted' ELSE 'hospital' END AS phase,
  CASE WHEN has_ed AND hour_idx <= e + 1 THEN {hour('ed_in')} + hour_idx * INTERVAL 1 HOUR ELSE coalesce({hour('adm_in')} + (hour_idx - first) * INTERVAL 1 HOUR, {hour('ed_in')} + hour_idx * INTERVAL 1 HOUR) END AS t FROM v3)"""
_LOC = f"""tr AS (SELECT visit, careunit AS label, coalesce(intime, outtime - INTERVAL 1 HOUR) AS a, coalesce(outtime, intime + INTERVAL 1 HOUR) AS b FROM transfers JOIN co USING (subject_id, hadm_id) WHERE careunit IS NOT NULL),
loc AS (SELECT DISTINCT visit, label, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b + INTERVAL 3599999999 MICROSECOND), INTERVAL 1 HOUR)) AS hour FROM tr WHERE b >= a)"""
_LABS = f"""lab AS (SELECT visit, start + (timepoint - 1) * INTERVAL 1 HOUR AS hour, k AS label, v AS text, {num('v')} AS num FROM (SELECT stay_id AS visit, timepoint, unnest(map_keys(lab_results)) AS k, unnest(map_values(lab_results)) AS v FROM patient_yaml) JOIN co USING (visit) WHERE v IS NOT NULL AND start IS NOT NULL)"""
_OMR = f"""om AS (SELECT visit, chartdate AS hour, result_name AS label, trim(result_value) AS text, {num('trim(result_value)')} AS num FROM omr JOIN co USING (subject_id) WHERE result_value IS NOT NULL AND result_name IS NOT NULL AND chartdate IS NOT NULL AND (dischtime IS NULL OR chartdate <= dischtime))"""
_CHART = f"""ch AS (SELECT visit, sub, itemid::VARCHAR AS label, {hour('charttime')} AS hour, value AS text, coalesce({num('valuenum')}, {num('value')}) AS num FROM chartevents c JOIN iu USING (stay_id) WHERE charttime IS NOT NULL AND itemid IS NOT NULL)"""


@R.add("visit_timepoints", f"WITH {_POINTS} SELECT visit, timepoint, hour_idx, phase, {at('t')} AS t FROM pt")
def visit_timepoints(s: S, sf: str) -> DF:
    return points(s, sf).select("visit", "timepoint", "hour_idx", "phase", stamp("t").alias("t"))


def _counted(h: DF) -> DF:
    return h.groupBy("visit", "sub", "section", "label").agg(F.count(F.lit(1)).alias("n"), F.count("num").alias("nums"), stamp(F.min("hour")).alias("first_at"), stamp(F.max("hour")).alias("last_at"))


_COUNTED = f"count(*) AS n, count(num) AS nums, {at('min(hour)')} AS first_at, {at('max(hour)')} AS last_at"


@R.add("build_admission", f"""WITH {_CORE}, {_LABS}, {_OMR}, tr AS (SELECT visit, careunit AS label, coalesce(intime, outtime - INTERVAL 1 HOUR) AS a, coalesce(outtime, intime + INTERVAL 1 HOUR) AS b FROM transfers JOIN co USING (subject_id, hadm_id) WHERE careunit IS NOT NULL),
h AS (SELECT visit, 'Patient Location' AS section, label, unnest(generate_series(date_trunc('hour', a), date_trunc('hour', b + INTERVAL 3599999999 MICROSECOND), INTERVAL 1 HOUR)) AS hour, NULL::DOUBLE AS num FROM tr WHERE b >= a
  UNION ALL SELECT visit, 'Lab Results', label, hour, num FROM lab UNION ALL SELECT visit, 'Outpatient Measurements', label, hour, num FROM om UNION ALL SELECT visit, 'General', '', start, NULL FROM co WHERE start IS NOT NULL)
SELECT visit, '' AS sub, section, label, {_COUNTED} FROM h GROUP BY visit, section, label""")
def build_admission(s: S, sf: str) -> DF:
    return _counted(V.build_admission(core(s, sf), {"transfers": table(s, sf, "transfers"), "omr": table(s, sf, "omr"), "labs": table(s, sf, "patient_yaml")}))


@R.add("build_icu", f"WITH {_CORE}, {_ICU}, {_CHART} SELECT visit, sub, 'Chart Events' AS section, label, {_COUNTED} FROM ch GROUP BY visit, sub, label")
def build_icu(s: S, sf: str) -> DF:
    return _counted(V.build_icu(icu_core(s, sf), {"chartevents": table(s, sf, "chartevents").drop("subject_id", "hadm_id")}))


_GENERAL_ED = "lower(coalesce(arrival_transport, 'unknown')) || ' patient, ' || CASE WHEN gender = 'F' THEN 'female, ' ELSE 'male, ' END || lower(coalesce(race, 'unknown'))"


@R.add("build_ed", f"WITH {_EDC} SELECT visit, 'General' AS section, {at(hour('intime'))} AS hour, {_GENERAL_ED} AS text FROM ed")
def build_ed(s: S, sf: str) -> DF:
    return V.build_ed(ed_core(s, sf), {}).select("visit", "section", stamp("hour").alias("hour"), "text")


@R.add("describe_ed", f"WITH {_POINTS} SELECT visit, timepoint, 'Emergency Department Stay.General' AS path, {_GENERAL_ED} AS value FROM pt JOIN ed USING (visit) WHERE {hour('intime')} <= t")
def describe_ed(s: S, sf: str) -> DF:
    return _dotted(V.describe_visit(V.build_ed(ed_core(s, sf), {}), points(s, sf)))


def _dotted(f: DF) -> DF:
    return f.select("visit", "timepoint", F.array_join("path", ".").alias("path"), "value")


_GENERAL_ADM = "lower(coalesce(admission_type, 'unknown')) || ' patient, insurance: ' || coalesce(insurance, 'unknown') || ', ' || lower(coalesce(race, 'unknown')) || ', language: ' || lower(coalesce(language, 'unknown'))"
_DESC = f"""{_POINTS}, {_LOC}, {_LABS}, {_OMR},
k0 AS (SELECT p.visit, timepoint, 'Hospital Stay.Lab Results.' || label AS path, hour, any_value(t) AS t, avg(num) AS m, max(text) AS x, false AS days FROM pt p JOIN lab USING (visit) WHERE hour <= t AND hour > t - INTERVAL 24 HOUR GROUP BY p.visit, timepoint, label, hour
  UNION ALL SELECT p.visit, timepoint, 'Hospital Stay.Outpatient Measurements.' || label, hour, any_value(t), avg(num), max(text), true FROM pt p JOIN om USING (visit) WHERE hour <= t AND hour::DATE >= (t - INTERVAL 24 HOUR)::DATE GROUP BY p.visit, timepoint, label, hour),
k AS (SELECT visit, timepoint, path, days, CASE WHEN days THEN date_diff('day', hour, t) ELSE (epoch(t - hour) / 3600)::BIGINT END AS ago, coalesce({text_sql('round(m, 6)')}, array_to_string(list_transform(list_filter(list_transform(string_split(x, ','), lambda y: trim(y)), lambda y, i: NOT list_contains(list_transform(string_split(x, ','), lambda z: trim(z))[1:i - 1], y)), lambda y: y), ', ')) AS s FROM k0),
n AS (SELECT *, row_number() OVER (PARTITION BY visit, timepoint, path ORDER BY ago) AS rd FROM k WHERE s IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(s) OVER w = s AND (lag(rd) OVER w <= 5) = (rd <= 5) THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY visit, timepoint, path ORDER BY ago DESC)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY visit, timepoint, path ORDER BY ago DESC) AS run FROM f),
g AS (SELECT visit, timepoint, path, run, any_value(days) AS days, any_value(s) AS s, any_value(rd <= 5) AS recent, max(ago) AS a, min(ago) AS b, string_agg(ago::VARCHAR, '/' ORDER BY ago DESC) AS hs FROM r GROUP BY visit, timepoint, path, run),
o AS (SELECT DISTINCT p.visit, timepoint, label, (epoch(t - hour) / 3600)::BIGINT AS ago FROM pt p JOIN loc USING (visit) WHERE hour <= t AND hour >= t - INTERVAL 24 HOUR),
i AS (SELECT visit, timepoint, label, max(ago) AS a, min(ago) AS b FROM (SELECT *, ago - row_number() OVER (PARTITION BY visit, timepoint, label ORDER BY ago) AS q FROM o) GROUP BY visit, timepoint, label, q),
de AS (SELECT visit, timepoint, path, string_agg(CASE WHEN recent THEN hs WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END || CASE WHEN days THEN ' days: ' ELSE ': ' END || s, ', ' ORDER BY run) AS value FROM g GROUP BY visit, timepoint, path
  UNION ALL SELECT visit, timepoint, 'Hospital Stay.Patient Location', string_agg(a::VARCHAR || '-' || b::VARCHAR || ': ' || label, ', ' ORDER BY a DESC, b DESC, label) FROM i GROUP BY visit, timepoint
  UNION ALL SELECT p.visit, timepoint, 'Hospital Stay.General', {_GENERAL_ADM} FROM pt p JOIN co USING (visit) WHERE start <= t)"""


def _admission(s: S, sf: str) -> DF:
    return V.build_admission(core(s, sf), {"transfers": table(s, sf, "transfers"), "omr": table(s, sf, "omr"), "labs": table(s, sf, "patient_yaml")})


def _described(s: S, sf: str) -> DF:
    return V.describe_visit(_admission(s, sf), points(s, sf))


@R.add("describe_admission", f"WITH {_DESC} SELECT visit, timepoint, path, value FROM de")
def describe_admission(s: S, sf: str) -> DF:
    return _dotted(_described(s, sf))


@R.add("describe_levels")
def describe_levels(s: S, sf: str) -> DF:
    """The last hour of every visit with all its history, at each level of summary: how many facts and how long."""
    p = points(s, sf)
    last = p.groupBy("visit").agg(F.max_by(F.struct("timepoint", "t"), "timepoint").alias("x")).select("visit", "x.*")
    h, out = history(s, sf), None
    for level in (0, 2, 3):
        d = V.describe_visit(h, last, trailing=None, level=level).groupBy(F.lit(level).alias("level"), F.get("path", F.lit(0)).alias("part")).agg(F.count(F.lit(1)).alias("facts"), F.sum(F.length("value")).alias("chars"))
        out = d if out is None else out.unionByName(d)
    return out


# -- change logs ------------------------------------------------------------------------------------------------------------
def codes(s: S, sf: str) -> DF:
    """Diagnosis categories of admissions, joined by semicolons."""
    c = core(s, sf).select("visit", "hadm_id")
    d = table(s, sf, "diagnoses_icd").where(F.trim("icd_version") == "9").select("hadm_id", icd_chapter(F.trim("icd_code")).alias("c")).where("c IS NOT NULL").distinct()
    return c.join(d, "hadm_id").groupBy("visit").agg(F.array_join(F.array_sort(F.collect_set("c")), C.CODES).alias("value")).withColumn("part", F.lit(V.ADM))


def change_facts(s: S, sf: str) -> DF:
    icu = icu_core(s, sf).select("visit", "sub", hour_round("intime").alias("intime"), hour_round("outtime").alias("outtime"))
    ends = C.end_cases(ed_core(s, sf).select("visit", "disposition", "outtime"), core(s, sf).select("visit", "discharge_location", "dischtime"))
    return C.change_facts(history(s, sf), points(s, sf), cut_lineage(icu), ends, codes(s, sf))


def changes(s: S, sf: str) -> DF:
    return cut_lineage(change_facts(s, sf))  # for queries that read them more than once


_CHG = f"""{_POINTS}, {_ICU}, {_LOC}, {_LABS}, {_CHART},
nx AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY visit ORDER BY timepoint), t + INTERVAL 1 HOUR) AS hour, coalesce(phase = 'ed' AND hour_idx = max(CASE WHEN phase = 'ed' THEN hour_idx END) OVER (PARTITION BY visit), false) AS last_ed, hour_idx = max(hour_idx) OVER (PARTITION BY visit) AS last FROM pt),
go AS (SELECT visit, timepoint, hour FROM nx WHERE NOT last_ed AND NOT last),
ov AS (SELECT visit, timepoint, 'Emergency Department Stay' AS part FROM nx WHERE last_ed UNION ALL SELECT visit, timepoint, 'Hospital Stay' FROM nx WHERE last AND NOT last_ed),
en AS (SELECT ed.visit, 'Emergency Department Stay' AS part, CASE WHEN disposition = 'EXPIRED' THEN 'DIED' WHEN disposition = 'ADMITTED' OR dischtime > outtime THEN 'ADMITTED' ELSE 'DISCHARGED' END AS value FROM ed LEFT JOIN co ON co.visit = ed.visit UNION ALL SELECT visit, 'Hospital Stay', CASE WHEN discharge_location = 'DIED' THEN 'DIED' ELSE 'DISCHARGED' END FROM co),
cd AS (SELECT visit, string_agg(DISTINCT c, ';' ORDER BY c) AS value FROM (SELECT visit, {icd_chapter_sql('trim(icd_code)')} AS c FROM diagnoses_icd JOIN co USING (hadm_id) WHERE trim(icd_version) = '9') WHERE c IS NOT NULL GROUP BY visit),
ih AS (SELECT visit, sub, {hour('intime')} AS a, {hour('outtime')} AS b FROM iu),
cf AS (SELECT visit, timepoint, 'Hospital Stay.Lab Results.' || label AS path, coalesce({text_sql('round(avg(num), 6)')}, max(text)) AS value FROM go JOIN lab USING (visit, hour) GROUP BY visit, timepoint, label
  UNION ALL SELECT visit, timepoint, 'ICU Stay.' || sub || '.Chart Events.' || label, coalesce({text_sql('round(avg(num), 6)')}, max(text)) FROM go JOIN ch USING (visit, hour) JOIN ih USING (visit, sub) WHERE hour >= a GROUP BY visit, timepoint, sub, label
  UNION ALL SELECT visit, timepoint, 'Hospital Stay.Patient Location', min(label) FROM go JOIN loc USING (visit, hour) GROUP BY visit, timepoint
  UNION ALL SELECT DISTINCT go.visit, timepoint, 'Hospital Stay.Disposition', 'ADMITTED TO ICU' FROM go JOIN ih ON ih.visit = go.visit AND go.hour = a
  UNION ALL SELECT go.visit, timepoint, 'ICU Stay.' || sub || '.Disposition', 'DISCHARGED FROM ICU' FROM go JOIN ih ON ih.visit = go.visit AND go.hour = b
  UNION ALL SELECT visit, timepoint, part || '.Disposition', value FROM ov JOIN en USING (visit, part) UNION ALL SELECT visit, timepoint, part || '.ICD categories', value FROM ov JOIN cd USING (visit) WHERE part = 'Hospital Stay'),
fa AS (SELECT * FROM cf WHERE value IS NOT NULL)"""


@R.add("change_visit", f"WITH {_CHG} SELECT visit, timepoint, path, value FROM fa")
def change_visit(s: S, sf: str) -> DF:
    return _dotted(changes(s, sf))


_FLAT = f"""{_CHG}, fl AS (SELECT visit, timepoint, CASE WHEN path LIKE '%.Disposition' THEN path || '.' || value ELSE path END AS path FROM fa WHERE path NOT LIKE '%.ICD categories' UNION ALL SELECT visit, timepoint, path || '.' || unnest(string_split(value, ';')) FROM fa WHERE path LIKE '%.ICD categories')"""


@R.add("change_path_counts", f"WITH {_FLAT} SELECT path, count(*) AS n FROM fl GROUP BY path")
def change_path_counts(s: S, sf: str) -> DF:
    return C.flat_paths(changes(s, sf)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@R.add("change_text_roundtrip", f"WITH {_CHG} SELECT visit, count(*) AS facts, sum(CASE WHEN path LIKE '%.ICD categories' THEN len(string_split(value, ';')) ELSE 1 END)::BIGINT AS typed FROM fa WHERE trim(value) <> '' GROUP BY visit")
def change_text_roundtrip(s: S, sf: str) -> DF:
    """Change logs written as text, read back and typed: every fact returns, a category each."""
    f = changes(s, sf).where("trim(value) <> ''")
    back = C.read_changes(C.change_text(f)).groupBy("visit").agg(F.count(F.lit(1)).alias("typed"))
    return f.groupBy("visit").agg(F.count(F.lit(1)).alias("facts")).join(back, "visit", "left").select("visit", "facts", "typed")


@R.add("fold_changes", f"WITH {_CHG}, h AS (SELECT visit FROM lab UNION ALL SELECT visit FROM ch UNION ALL SELECT visit FROM fa WHERE path NOT LIKE '%.Disposition' AND path NOT LIKE '%.ICD categories' AND path <> 'Hospital Stay.Patient Location' AND trim(value) <> '') SELECT visit, count(*) AS n FROM h GROUP BY visit")
def fold_changes(s: S, sf: str) -> DF:
    """Readings of visits with those that their change logs bring appended."""
    h = history(s, sf)
    p = points(s, sf)
    state, _ = C.fold(h.where("kind = 'value' AND section <> 'Outpatient Measurements'"), C.typed_facts(changes(s, sf)).where("kind IN ('value', 'end')"), p)
    return state.groupBy("visit").agg(F.count(F.lit(1)).alias("n"))


# -- sections, weights, tasks -----------------------------------------------------------------------------------------------
def _index(s: S, sf: str) -> DF:
    d = _described(s, sf).unionByName(V.describe_visit(V.build_ed(ed_core(s, sf), {}), points(s, sf)))
    return cut_lineage(G.section_index(d, changes(s, sf), G.dimension(s)))


_WITH_ICU = f"{_DESC}, {_ICU}, {_CHART}, {_CHG[_CHG.index('nx AS ('):]}"


@R.add("section_index", f"""WITH {_WITH_ICU}, th AS (SELECT DISTINCT visit, timepoint, CASE WHEN path LIKE '%Lab Results%' THEN 'HS_LabResults' WHEN path LIKE '%Outpatient%' THEN 'HS_OutpatientMeasurements' ELSE 'HS_General__HA_PatientLocation__HA_CareTaker' END AS section_name FROM de
  UNION SELECT visit, timepoint, 'ED_Stay' FROM pt JOIN ed USING (visit) WHERE {hour('intime')} <= t),
mv AS (SELECT DISTINCT visit, timepoint, CASE WHEN path LIKE 'Hospital Stay.Lab Results%' THEN 'HS_LabResults' WHEN path LIKE 'Emergency%' THEN 'ED_Stay' END AS section_name FROM fa WHERE path LIKE 'Hospital Stay.Lab Results%' OR path LIKE 'Emergency%')
SELECT section_name, visit, '' AS sub, timepoint, CASE WHEN mv.visit IS NOT NULL THEN 'changed' ELSE 'empty' END AS state FROM th LEFT JOIN mv USING (visit, timepoint, section_name) WHERE section_name IN ('HS_LabResults', 'ED_Stay')
UNION ALL SELECT section_name, visit, '', min(timepoint), 'static' FROM th WHERE section_name NOT IN ('HS_LabResults', 'ED_Stay') GROUP BY section_name, visit""")
def section_index(s: S, sf: str) -> DF:
    return _index(s, sf)


@R.add("section_draw")
def section_draw(s: S, sf: str) -> DF:
    """A thousand draws by section, and their unchanged extras."""
    return G.draw_sections(_index(s, sf), 1000, "sections")


_U = lambda seed, *keys: "((('0x' || substr(md5(concat_ws('|', '" + seed + "', " + ", ".join(f"{k}::VARCHAR" for k in keys) + ")), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296.0)"
_WEIGHTS = f"""{_FLAT}, n AS (SELECT path, count(*)::DOUBLE AS n FROM fl GROUP BY path), tt AS (SELECT sum(n) AS total, max(n) AS most, coalesce(max(n) FILTER (path = 'Hospital Stay.Disposition.DISCHARGED'), max(n)) AS ae, coalesce(max(n) FILTER (path = 'Emergency Department Stay.Disposition.DISCHARGED'), max(n)) AS ee, coalesce(max(n) FILTER (path = 'Hospital Stay.ICD categories.circulatory'), max(n)) AS ai FROM n),
w AS (SELECT path, CASE WHEN path LIKE 'Hospital Stay.Disposition.%' THEN -ln(ae / total + 1e-10) * (ae / total + 1e-10) / (n / total + 1e-10) WHEN path LIKE 'Emergency%.Disposition.%' THEN -ln(ee / total + 1e-10) * (ee / total + 1e-10) / (n / total + 1e-10) WHEN path LIKE 'Hospital Stay.ICD categories.%' THEN -ln(ai / total + 1e-10) * (ai / total + 1e-10) / (n / total + 1e-10) / 2 ELSE -ln(n / total + 1e-10) END AS w, path LIKE '%ICD categories%' OR path LIKE 'ICU Stay%Disposition%' AS pooled FROM n, tt),
e AS (SELECT visit, timepoint, CASE WHEN pooled THEN 'p' ELSE path || '|' || row_number() OVER () END AS k, pow(avg(pow(w, 3)), 1 / 3.0) AS w FROM fl JOIN w USING (path) GROUP BY visit, timepoint, CASE WHEN pooled THEN 'p' ELSE path || '|' || row_number() OVER () END),
rw AS (SELECT visit, timepoint, pow(avg(pow(w, 3)), 1 / 3.0) AS raw FROM e GROUP BY visit, timepoint),
ew AS (SELECT pt.visit, pt.timepoint, coalesce(raw, -ln(most / total + 1e-10)) AS raw FROM pt CROSS JOIN tt LEFT JOIN rw ON rw.visit = pt.visit AND rw.timepoint = pt.timepoint)"""
_WEIGHTS = _WEIGHTS.replace("e AS (SELECT visit, timepoint, CASE WHEN pooled THEN 'p' ELSE path || '|' || row_number() OVER () END AS k, pow(avg(pow(w, 3)), 1 / 3.0) AS w FROM fl JOIN w USING (path) GROUP BY visit, timepoint, CASE WHEN pooled THEN 'p' ELSE path || '|' || row_number() OVER () END)", "fr AS (SELECT fl.*, row_number() OVER () AS rid FROM fl), e AS (SELECT visit, timepoint, pow(avg(pow(w, 3)), 1 / 3.0) AS w FROM fr JOIN w USING (path) GROUP BY visit, timepoint, CASE WHEN pooled THEN -1 ELSE rid END)")


@R.add("event_weights", f"WITH {_WEIGHTS} SELECT visit, timepoint, round(raw, 5) AS raw FROM ew")
def event_weights(s: S, sf: str) -> DF:
    return K.event_weights(C.flat_paths(changes(s, sf)), points(s, sf)).select("visit", "timepoint", F.round("raw", 5).alias("raw"))


_EDCO = f"{_WEIGHTS}, ec AS (SELECT ew.visit, ew.timepoint, raw, CASE WHEN en.value = 'ADMITTED' THEN 1 ELSE 0 END AS label FROM ew JOIN pt USING (visit, timepoint) JOIN en ON en.visit = ew.visit AND en.part = 'Emergency Department Stay' WHERE phase = 'ed')"


def _ed_cohort(s: S, sf: str) -> DF:
    """Emergency hours with whether the stay ends in an admission, and their weight."""
    ends = C.end_cases(ed_core(s, sf).select("visit", "disposition", "outtime"), core(s, sf).select("visit", "discharge_location", "dischtime")).where(F.col("part") == V.ED)
    p = points(s, sf)
    w = K.event_weights(C.flat_paths(changes(s, sf)), p).select("visit", "timepoint", F.round("raw", 5).alias("raw"))
    return cut_lineage(p.where("phase = 'ed'").select("visit", "timepoint").join(w, ["visit", "timepoint"]).join(ends, "visit").select("visit", "timepoint", "raw", (F.col("value") == "ADMITTED").cast("int").alias("label")))


@R.add("resample_ed_admission", f"""WITH {_EDCO}, dr AS (SELECT * FROM ec WHERE round(raw, 5) > 0 ORDER BY -ln({_U('ed', 'visit', 'timepoint')}) / round(raw, 5), visit, timepoint LIMIT 500), k AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM dr GROUP BY label)),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_U('ed|balance', 'visit', 'timepoint')}, visit, timepoint) AS rn FROM dr) SELECT visit, timepoint, label FROM rk, k WHERE rn <= k""")
def resample_ed_admission(s: S, sf: str) -> DF:
    return K.resample(_ed_cohort(s, sf), ["visit", "timepoint"], "label", 500, "ed", weight="raw").select("visit", "timepoint", "label")


@R.add("task_rows_hospital_icd", f"""WITH {_WITH_ICU} SELECT o.visit, o.timepoint, cd.value AS label, (SELECT count(*) FROM de WHERE de.visit = o.visit AND de.timepoint = o.timepoint) AS facts FROM ov o JOIN cd ON cd.visit = o.visit WHERE part = 'Hospital Stay'""")
def task_rows_hospital_icd(s: S, sf: str) -> DF:
    """The last hour of each hospital stay with its diagnosis categories and what was known."""
    p = points(s, sf).where("last AND NOT last_ed")
    cohort = cut_lineage(p.join(codes(s, sf).select("visit", F.col("value").alias("label")), "visit").select("visit", "timepoint", "t", "label"))
    return K.task_rows(cohort, V.describe_visit(_admission(s, sf), cohort)).select("visit", "timepoint", "label", F.size("desc").cast("bigint").alias("facts"))


@R.add("future_dispositions", f"WITH {_POINTS}, a AS (SELECT visit, {hour('dischtime')} AS b, CASE WHEN discharge_location = 'DIED' THEN 'DIED' ELSE 'DISCHARGED' END AS v FROM co) SELECT visit, timepoint, v AS future, CASE WHEN epoch(b - t) / 3600 <= 24 THEN v ELSE 'ALIVE' END AS day, CASE WHEN epoch(b - t) / 3600 > 72 THEN 'STAYED' ELSE 'DISCHARGED' END AS over FROM pt JOIN a USING (visit) WHERE b >= t AND phase = 'hospital'")
def future_dispositions(s: S, sf: str) -> DF:
    a = core(s, sf).select("visit", F.lit(V.ADM).alias("part"), hour_round("dischtime").alias("end_at"), F.when(F.col("discharge_location") == "DIED", "DIED").otherwise("DISCHARGED").alias("value"))
    f = K.later(points(s, sf).where("phase = 'hospital'"), a)
    pick = lambda n: F.max(F.when(F.element_at("path", -1) == n, F.col("value")))
    return f.groupBy("visit", "timepoint").agg(pick("Future Disposition").alias("future"), pick("24h Disposition").alias("day"), pick("StayOver3days").alias("over"))


@R.add("los_left", f"WITH {_POINTS}, a AS (SELECT visit, start AS a, {hour('dischtime')} AS b FROM co) SELECT visit, timepoint, floor(epoch(b - t) / 3600)::BIGINT::VARCHAR || ' hours' AS value FROM pt JOIN a USING (visit) WHERE t >= a AND b >= t")
def los_left(s: S, sf: str) -> DF:
    ends = core(s, sf).select("visit", F.lit(V.ADM).alias("part"), F.lit("").alias("sub"), F.col("start").alias("begin_at"), hour_round("dischtime").alias("end_at"))
    return V.los_facts(points(s, sf), ends, mode="exact").select("visit", "timepoint", "value")


@R.add("variable_bounds", f"WITH {_CORE}, {_ICU}, {_LABS}, {_OMR}, {_CHART}, x AS (SELECT 'Lab Results' AS section, label, num FROM lab UNION ALL SELECT 'Outpatient Measurements', label, num FROM om UNION ALL SELECT 'Chart Events', label, num FROM ch) SELECT section, label, min(num) AS least, max(num) AS most, round(quantile_cont(num, 0.01), 5) AS p1, round(quantile_cont(num, 0.99), 5) AS p99 FROM x WHERE num IS NOT NULL GROUP BY section, label")
def variable_bounds(s: S, sf: str) -> DF:
    return Z.variable_bounds(history(s, sf)).select("section", "label", "least", "most", F.round("p1", 5).alias("p1"), F.round("p99", 5).alias("p99"))


# -- evaluation and simulation ----------------------------------------------------------------------------------------------
def _typed(s: S, sf: str) -> tuple[DF, DF]:
    """Changes of the ICU stays, and as predictions those of the hour before."""
    t = C.typed_facts(changes(s, sf)).where(F.col("part") == V.ICU)
    return t, t.withColumn("timepoint", F.col("timepoint") + 1)


_MET = f"""{_CHG}, g AS (SELECT visit, timepoint, path, value, {num('value')} AS x FROM fa WHERE path LIKE 'ICU Stay.%' AND trim(value) <> ''), e AS (SELECT * FROM g WHERE path NOT LIKE '%.Disposition'), q AS (SELECT visit, timepoint + 1 AS timepoint, path, value, x FROM e),
j AS (SELECT coalesce(e.path, q.path) AS path, e.path IS NOT NULL AS g, q.path IS NOT NULL AS p, e.value AS gv, q.value AS pv, e.x AS gx, q.x AS px FROM e FULL JOIN q ON q.visit = e.visit AND q.timepoint = e.timepoint AND q.path = e.path),
bo AS (SELECT string_split(path, '.')[4] AS label, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM e WHERE x IS NOT NULL GROUP BY 1),
nu AS (SELECT coalesce(gx, lo) AS a, coalesce(px, CASE WHEN abs(gx - lo) >= abs(gx - hi) THEN lo ELSE hi END) AS b, lo, hi FROM j JOIN bo ON bo.label = string_split(path, '.')[4] WHERE (gx IS NOT NULL OR NOT g) AND (px IS NOT NULL OR NOT p)),
ns AS (SELECT (greatest(lo, least(hi, a)) - lo) / (hi - lo) AS a, (greatest(lo, least(hi, b)) - lo) / (hi - lo) AS b FROM nu WHERE hi > lo),
ws AS (SELECT coalesce(gv, 'UNKNOWN') = coalesce(pv, 'UNKNOWN') AS ok FROM j WHERE NOT ((gx IS NOT NULL OR NOT g) AND (px IS NOT NULL OR NOT p))),
c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM j)"""


@R.add("change_metrics", f"WITH {_MET} SELECT 'precision' AS metric, round(tp / (tp + fp), 5) AS value FROM c UNION ALL SELECT 'recall', round(tp / (tp + fn), 5) FROM c UNION ALL SELECT 'f1', round(2.0 * tp / (2 * tp + fp + fn), 5) FROM c UNION ALL SELECT 'rmse', round(sqrt(avg(pow(a - b, 2))), 5) FROM ns UNION ALL SELECT 'mae', round(avg(abs(a - b)), 5) FROM ns UNION ALL SELECT 'accuracy', round(count(*) FILTER (ok) / count(*), 5) FROM ws")
def change_metrics(s: S, sf: str) -> DF:
    g, p = _typed(s, sf)
    b = g.where("kind = 'value' AND num IS NOT NULL").groupBy("section", "label").agg(F.percentile("num", F.lit(0.01)).alias("low"), F.percentile("num", F.lit(0.99)).alias("high"))
    m = Z.change_metrics(g, p, b).where("level = 'domain' AND kind IN ('event', 'numerical', 'categorical') AND domain = 'ICU Stay.Chart Events' AND metric NOT IN ('tp', 'fp', 'fn', 'skipped')")
    return m.select("metric", F.round("value", 5).alias("value"))


@R.add("outcome_report", "WITH i AS (SELECT stay_id, max(hadm_id) AS hadm_id, min(intime) AS a, max(outtime) AS b FROM icustays WHERE intime IS NOT NULL GROUP BY stay_id), d AS (SELECT hadm_id, max(hospital_expire_flag) AS f FROM admissions GROUP BY hadm_id), x AS (SELECT CASE WHEN b IS NOT NULL AND epoch(b - a) / 3600 > 72 THEN 1 ELSE 0 END AS g, CASE WHEN b IS NOT NULL THEN (epoch(b - a) / 3600 > 72)::INT WHEN f = 1 THEN NULL ELSE 1 END AS p FROM i LEFT JOIN d ON d.hadm_id = i.hadm_id), c AS (SELECT count(*) AS n, count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g = 0 AND p = 1) AS fp, count(*) FILTER (g = 1 AND coalesce(p, 0) = 0) AS fn, count(*) FILTER (g = 0 AND coalesce(p, 0) = 0) AS tn, count(*) FILTER (p IS NULL) AS m FROM x) SELECT n, round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, CASE WHEN m = 0 AND tp + fn > 0 AND tn + fp > 0 THEN round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) END AS auc FROM c")
def outcome_report(s: S, sf: str) -> DF:
    """Stays of over three days against the rule for simulated ones: an open stay counts as long unless the patient died."""
    i = table(s, sf, "icustays").where("intime IS NOT NULL").groupBy("stay_id").agg(F.max("hadm_id").alias("hadm_id"), F.min("intime").alias("a"), F.max("outtime").alias("b"))
    d = table(s, sf, "admissions").groupBy("hadm_id").agg(F.max("hospital_expire_flag").alias("f"))
    h = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 3.6e9
    x = i.join(d, "hadm_id", "left").select(F.coalesce((h > 72).cast("int"), F.lit(0)).alias("g"), Z.outcome_label("icu_los", F.when(F.col("f") == 1, "DIED"), F.col("b").isNotNull(), h).alias("p"))
    r = Z.binary_report(x, "g", "p")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "auc")])


@R.add("icd_report", f"WITH {_CORE}, d AS (SELECT hadm_id, list(DISTINCT {icd_chapter_sql('trim(icd_code)')}) AS g, list(DISTINCT {icd_chapter_sql('trim(icd_code)')}) FILTER (seq_num = 1) AS p FROM diagnoses_icd WHERE trim(icd_version) = '9' GROUP BY hadm_id), x AS (SELECT label, coalesce(list_contains(g, label), false) AS g, coalesce(list_contains(p, label), false) AS p FROM d, (SELECT unnest([{', '.join(repr(n) for n, _, _ in CHAPTERS)}]) AS label)), c AS (SELECT label, count(*) AS n, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM x GROUP BY label) SELECT label, n, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) END AS auc FROM c")
def icd_report(s: S, sf: str) -> DF:
    """All diagnosis categories of an admission against that of its first code."""
    c = icd_chapter(F.trim("icd_code"))
    d = table(s, sf, "diagnoses_icd").where(F.trim("icd_version") == "9").groupBy("hadm_id").agg(F.collect_set(c).alias("g"), F.collect_set(F.when(F.col("seq_num") == 1, c)).alias("p"))
    r = Z.multilabel_report(d, "g", "p", [n for n, _, _ in CHAPTERS])
    return r.select("label", "n", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "auc")])


@R.add("simulate_visits")
def simulate_visits_query(s: S, sf: str) -> DF:
    """Visits rolled on from the middle of their hospital stay by repeating the latest readings, three hours at most."""
    p = points(s, sf).where("phase = 'hospital'")
    mid = p.groupBy("visit").agg(F.max("timepoint").alias("z"), F.min("timepoint").alias("a")).withColumn("timepoint", F.floor((F.col("a") + F.col("z")) / 2).cast("int")).select("visit", "timepoint")
    start = p.join(mid, ["visit", "timepoint"]).select("visit", "timepoint", "t")
    steps, _ = simulate_visits(history(s, sf).where("section <> 'Outpatient Measurements'"), start, max_steps=3)
    return steps

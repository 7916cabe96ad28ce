"""Further queries: stay clocks, code maps, outcome rules, tolerant scores, text spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators.common import attach
from stayline.functions.icd import icd_chapter, icd_chapter_sql
from stayline.functions.time import stamp
from stayline.operators import budget as B
from stayline.operators import cohorts as C
from stayline.operators import metrics as M
from stayline.operators import snapshot as N
from stayline.plans.catalogue_joins import _SIDES, _sides, readings
from stayline.plans.registry import Registry, table
from stayline.plans.sql import READINGS, at

R = Registry()
DF, S = DataFrame, SparkSession


@R.add("timepoint_phase", "WITH d AS (SELECT DISTINCT stay_id, coalesce(ed_stay_hours, 0) AS e, greatest(floor(coalesce(hosp_stay_hours, 0))::BIGINT, 0) AS n FROM stay_to_ids_dict WHERE adm_id IS NOT NULL), h AS (SELECT stay_id, e, unnest(range(-1, n + 1)) AS hour_idx FROM d) SELECT stay_id, hour_idx, CASE WHEN e > 0 AND hour_idx <= e THEN 'ed' WHEN e > 0 AND hour_idx = e + 1 THEN 'admitted' ELSE 'hospital' END AS phase FROM h")
def timepoint_phase(s: S, sf: str) -> DF:
    d = table(s, sf, "stay_to_ids_dict").where("adm_id IS NOT NULL").select("stay_id", F.coalesce("ed_stay_hours", F.lit(0.0)).alias("e"), F.greatest(F.floor(F.coalesce("hosp_stay_hours", F.lit(0.0))), F.lit(0).cast("bigint")).alias("n")).distinct()
    h = d.withColumn("hour_idx", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.col("n"))))
    return h.select("stay_id", "hour_idx", N.phase(F.col("hour_idx"), F.col("e")).alias("phase"))


@R.add("transfers_as_of", f"WITH t AS (SELECT DISTINCT hadm_id, transfer_id, intime FROM transfers WHERE hadm_id IS NOT NULL), p AS (SELECT hadm_id, max(intime) AS t FROM t GROUP BY hadm_id) SELECT p.hadm_id, count(*) AS n, {at('min(intime)')} AS first_at FROM p JOIN t ON t.hadm_id = p.hadm_id AND t.intime <= p.t AND t.intime >= p.t - INTERVAL 48 HOUR GROUP BY p.hadm_id, p.t")
def transfers_as_of(s: S, sf: str) -> DF:
    t = table(s, sf, "transfers").where("hadm_id IS NOT NULL").select("hadm_id", "transfer_id", "intime").distinct()
    p = t.groupBy("hadm_id").agg(F.max("intime").alias("t"))
    return N.as_of("transfers", t, p, ["hadm_id"], "intime", trailing_hours=48).groupBy("hadm_id").agg(F.count(F.lit(1)).alias("n"), stamp(F.min("intime")).alias("first_at"))


@R.add("icu_only_once_begun", "SELECT c.stay_id, itemid, count(*) AS n FROM chartevents c JOIN (SELECT stay_id, max(intime) AS a FROM icustays GROUP BY stay_id) i ON i.stay_id = c.stay_id WHERE charttime >= a GROUP BY c.stay_id, itemid")
def icu_only_once_begun(s: S, sf: str) -> DF:
    i = table(s, sf, "icustays").groupBy("stay_id").agg(F.max("intime").alias("a"))
    c = table(s, sf, "chartevents").select("stay_id", "itemid", "charttime").join(i, "stay_id")
    return N.begun(c, F.col("charttime"), F.col("a")).groupBy("stay_id", "itemid").agg(F.count(F.lit(1)).alias("n"))


_MAP = "SELECT DISTINCT trim(a.icd_code) AS ten, trim(b.icd_code) AS nine FROM d_icd_diagnoses a JOIN d_icd_diagnoses b ON trim(a.icd_version) = '10' AND trim(b.icd_version) = '9' AND a.long_title = b.long_title"


@R.add("code_mapping_categories", f"WITH m AS ({_MAP}) SELECT DISTINCT hadm_id, {icd_chapter_sql('nine')} AS category FROM diagnoses_icd d JOIN m ON m.ten = trim(d.icd_code) WHERE trim(d.icd_version) = '10'")
def code_mapping_categories(s: S, sf: str) -> DF:
    """Categories of version 10 codes through those of version 9 with the same title."""
    d = table(s, sf, "d_icd_diagnoses").where("long_title IS NOT NULL").select(F.trim("icd_code").alias("c"), F.trim("icd_version").alias("v"), "long_title")
    m = d.where("v = '10'").select(F.col("c").alias("ten"), "long_title").join(d.where("v = '9'").select(F.col("c").alias("nine"), "long_title"), "long_title")
    x = table(s, sf, "diagnoses_icd").where(F.trim("icd_version") == "10").select("hadm_id", "icd_code")
    return C.map_codes(x, m, "icd_code", "ten", "nine").select("hadm_id", icd_chapter(F.col("nine")).alias("category")).distinct()


@R.add("top_units_by_mean_count", "WITH t AS (SELECT DISTINCT hadm_id, transfer_id, careunit FROM transfers WHERE careunit IS NOT NULL AND hadm_id IS NOT NULL), c AS (SELECT careunit, count(*) AS n, count(DISTINCT hadm_id) AS stays FROM t GROUP BY careunit), k AS (SELECT round_even(count(*) / count(DISTINCT hadm_id), 0) AS k FROM t) SELECT careunit FROM (SELECT careunit, row_number() OVER (ORDER BY n DESC, careunit) AS rn FROM c), k WHERE rn <= k")
def top_units_by_mean_count(s: S, sf: str) -> DF:
    """The k commonest units, k being the rounded mean number per stay: a baseline's guess of a list."""
    t = table(s, sf, "transfers").where("careunit IS NOT NULL AND hadm_id IS NOT NULL").select("hadm_id", "transfer_id", "careunit").distinct()
    k = t.agg(F.bround(F.count(F.lit(1)) / F.countDistinct("hadm_id"), 0).alias("k"))
    c = t.groupBy("careunit").agg(F.count(F.lit(1)).alias("n")).transform(attach, k).withColumn("g", F.lit(0))
    return C.top_of(c, ["g"], "careunit", "n", F.max("k")).select(F.explode("top").alias("careunit"))


@R.add("predicted_names_accuracy", f"WITH {READINGS}, b AS (SELECT stay_id, min(hour) AS a FROM readings GROUP BY stay_id), g AS (SELECT DISTINCT r.stay_id, itemid FROM readings r JOIN b USING (stay_id) WHERE hour < a + INTERVAL 6 HOUR), p AS (SELECT DISTINCT r.stay_id, itemid FROM readings r JOIN b USING (stay_id) WHERE hour >= a + INTERVAL 6 HOUR AND hour < a + INTERVAL 12 HOUR) SELECT round(count(g.itemid) / count(*), 6) AS accuracy, count(g.itemid) AS correct, count(*) - count(g.itemid) AS incorrect FROM p LEFT JOIN g ON g.stay_id = p.stay_id AND g.itemid = p.itemid")
def predicted_names_accuracy(s: S, sf: str) -> DF:
    r = readings(s, sf)
    r = r.join(r.groupBy("stay_id").agg(F.min("hour").alias("a")), "stay_id")
    early = F.col("hour") < F.col("a") + F.expr("INTERVAL 6 HOURS")
    late = ~early & (F.col("hour") < F.col("a") + F.expr("INTERVAL 12 HOURS"))
    d = r.groupBy("stay_id").agg(F.collect_set(F.when(early, F.col("itemid"))).alias("g"), F.collect_set(F.when(late, F.col("itemid"))).alias("p"))
    return M.false_positive_accuracy(d, "g", "p").withColumn("accuracy", F.round("accuracy", 6))


@R.add("tolerant_scores", _SIDES + """, tt AS (SELECT stay_id, CASE WHEN v > 125 THEN 'high' ELSE 'low' END AS e, t, v FROM t), pp AS (SELECT stay_id, CASE WHEN v > 125 THEN 'high' ELSE 'low' END AS e, t, v FROM p),
n AS (SELECT p.e, p.v, t.v AS g, row_number() OVER (PARTITION BY p.stay_id, p.e, p.t, p.v ORDER BY abs(p.v - t.v), t.t, t.v) AS rn FROM pp p JOIN tt t ON t.stay_id = p.stay_id AND t.e = p.e AND abs(epoch_us(t.t) - epoch_us(p.t)) <= 3600000000),
a AS (SELECT e, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn FROM (SELECT e, EXISTS (SELECT 1 FROM pp p WHERE p.stay_id = tt.stay_id AND p.e = tt.e AND abs(epoch_us(tt.t) - epoch_us(p.t)) <= 3600000000) AS hit FROM tt) GROUP BY e),
b AS (SELECT e, count(*) FILTER (NOT hit) AS fp FROM (SELECT e, EXISTS (SELECT 1 FROM tt t WHERE t.stay_id = pp.stay_id AND t.e = pp.e AND abs(epoch_us(t.t) - epoch_us(pp.t)) <= 3600000000) AS hit FROM pp) GROUP BY e)
SELECT e, tp, fp, fn, rmse, mae FROM a JOIN b USING (e) JOIN (SELECT e, round(sqrt(avg(pow(g - v, 2))), 6) AS rmse, round(avg(abs(g - v)), 6) AS mae FROM n WHERE rn = 1 GROUP BY e) USING (e)""")
def tolerant_scores(s: S, sf: str) -> DF:
    t, p = (x.withColumn("e", F.when(F.col("v") > 125, "high").otherwise("low")) for x in _sides(s, sf))
    m = M.tolerant_scores(t, p, ["stay_id"], "e", "t", "v", 3600)
    return m.withColumns({c: F.round(c, 6) for c in ("rmse", "mae")})


@R.add("word_spellings", "SELECT stay_id, itemid, CASE WHEN contains(lower(trim(value)), 'unable') OR contains(lower(trim(value)), 'uta') OR contains(lower(trim(value)), 'u/a') THEN 'unable to assess' WHEN contains(lower(trim(value)), 'sleep') THEN 'sleeping' WHEN contains(lower(trim(value)), '/10') THEN split_part(lower(trim(value)), '/', 1) || '.0' ELSE lower(trim(value)) END AS word, count(*) AS n FROM chartevents WHERE value IS NOT NULL AND valuenum IS NULL AND stay_id IS NOT NULL GROUP BY ALL")
def word_spellings(s: S, sf: str) -> DF:
    c = table(s, sf, "chartevents").where("value IS NOT NULL AND valuenum IS NULL AND stay_id IS NOT NULL")
    return c.select("stay_id", "itemid", M.plain_words(F.lit("pain"), F.col("value")).alias("word")).groupBy("stay_id", "itemid", "word").agg(F.count(F.lit(1)).alias("n"))


@R.add("outcome_rules", "SELECT DISTINCT i.stay_id, CASE WHEN i.outtime IS NOT NULL THEN (CASE WHEN epoch(i.outtime - i.intime) / 3600.0 > 72 THEN '1' ELSE '0' END) WHEN a.f = 1 THEN NULL ELSE '1' END AS label FROM icustays i LEFT JOIN (SELECT hadm_id, max(hospital_expire_flag) AS f FROM admissions GROUP BY hadm_id) a ON a.hadm_id = i.hadm_id")
def outcome_rules(s: S, sf: str) -> DF:
    a = table(s, sf, "admissions").groupBy("hadm_id").agg(F.max("hospital_expire_flag").alias("f"))
    i = table(s, sf, "icustays").join(a, "hadm_id", "left")
    hours = (F.unix_micros(F.col("outtime").cast("timestamp")) - F.unix_micros(F.col("intime").cast("timestamp"))) / 3.6e9
    return i.select("stay_id", M.outcome(F.when(F.col("f") == 1, "DIED"), F.col("outtime").isNotNull(), hours).cast("string").alias("label")).distinct()


@R.add("admission_mortality_label", "SELECT hadm_id, max(hospital_expire_flag)::INT AS label FROM admissions WHERE hospital_expire_flag IS NOT NULL GROUP BY hadm_id")
def admission_mortality_label(s: S, sf: str) -> DF:
    return C.hospital_mortality(table(s, sf, "admissions"))


@R.add("quarter_shards", "SELECT doc_id, least((row_number() OVER (ORDER BY doc_id) - 1) // greatest((count(*) OVER ()) // 4, 1), 3) AS part FROM documents")
def quarter_shards(s: S, sf: str) -> DF:
    return B.position_shards(table(s, sf, "documents").select("doc_id"), "doc_id", 4)


@R.add("medication_dedupe_first", f"SELECT subject_id, stay_id, {at('charttime')} AS charttime, itemid, v FROM (SELECT subject_id, stay_id, charttime, itemid, string_agg(DISTINCT value, ';' ORDER BY value) AS v FROM chartevents WHERE value IS NOT NULL AND charttime IS NOT NULL AND stay_id IS NOT NULL GROUP BY ALL)")
def medication_dedupe_first(s: S, sf: str) -> DF:
    """One row per key, its distinct values joined."""
    c = table(s, sf, "chartevents").where("value IS NOT NULL AND charttime IS NOT NULL AND stay_id IS NOT NULL")
    g = c.groupBy("subject_id", "stay_id", "charttime", "itemid").agg(F.array_join(F.array_sort(F.collect_set("value")), ";").alias("v"))
    return g.withColumn("charttime", stamp("charttime"))

"""Cohort, sampling, metric, budget and simulation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stayline.operators.common import attach, join_dimension
from stayline.functions.hashing import uniform, uniform_sql
from stayline.functions.icd import CHAPTERS, icd_chapter, icd_chapter_sql
from stayline.functions.numeric import min_max, text_of
from stayline.functions.time import hour_index, hours_between, micros, stamp
from stayline.operators import budget as B
from stayline.operators import cohorts as C
from stayline.operators import metrics as M
from stayline.operators import sampling as X
from stayline.operators.simulate import simulate
from stayline.plans.catalogue_joins import readings
from stayline.plans.registry import Registry, table
from stayline.plans.sql import READINGS, at
from stayline.plans.sql import text_of as text_sql

R = Registry()
DF, S = DataFrame, SparkSession
_U = lambda seed, *keys: uniform_sql("concat_ws('|', '" + seed + "', " + ", ".join(f"{k}::VARCHAR" for k in keys) + ")")


# -- cohorts --------------------------------------------------------------------------------------------------------------
@R.add("patient_split", f"WITH p AS (SELECT DISTINCT subject_id FROM admissions WHERE subject_id IS NOT NULL), r AS (SELECT subject_id, row_number() OVER (ORDER BY {_U('split', 'subject_id')}, subject_id) AS rn, count(*) OVER () AS n FROM p) SELECT subject_id, CASE WHEN rn <= floor(n * 0.95) THEN 'train' WHEN rn <= floor(n * 0.95) + floor(n * 0.025) THEN 'val' ELSE 'test' END AS split FROM r")
def patient_split(s: S, sf: str) -> DF:
    return C.rank_split(table(s, sf, "admissions"), "subject_id", "split")


@R.add("first_timepoint_label", "SELECT DISTINCT stay_id, CASE WHEN disposition = 'ADMITTED' THEN 1 ELSE 0 END AS label FROM ed_stays WHERE disposition IN ('ADMITTED', 'HOME') AND ed_stay_hours > 0")
def first_timepoint_label(s: S, sf: str) -> DF:
    return C.ed_admission(table(s, sf, "ed_stays"))


_CHAP = f"CASE WHEN trim(icd_version) = '9' THEN {icd_chapter_sql('trim(icd_code)')} END"
_NAMES = [n for n, _, _ in CHAPTERS]


@R.add("one_hot_labels", f"WITH g AS (SELECT hadm_id, list({_CHAP}) AS cs FROM diagnoses_icd GROUP BY hadm_id) SELECT hadm_id, " + " || ".join(f"coalesce(list_contains(cs, '{n}'), false)::INT::VARCHAR" for n in _NAMES) + " AS hot FROM g")
def one_hot_labels(s: S, sf: str) -> DF:
    c = F.when(F.trim("icd_version") == "9", icd_chapter(F.trim("icd_code")))
    g = table(s, sf, "diagnoses_icd").groupBy("hadm_id").agg(F.collect_set(c).alias("cs"))
    return g.select("hadm_id", F.array_join(F.transform(C.one_hot(F.col("cs"), _NAMES), lambda x: x.cast("string")), "").alias("hot"))


@R.add("los_over_3d", f"SELECT DISTINCT stay_id, {at('intime + INTERVAL 24 HOUR')} AS t, (outtime - (intime + INTERVAL 24 HOUR) > INTERVAL 72 HOUR) AS label FROM icustays WHERE outtime > intime + INTERVAL 24 HOUR")
def los_over_3d(s: S, sf: str) -> DF:
    return C.icu_long_stay(table(s, sf, "icustays")).withColumn("t", stamp("t"))


@R.add("los_band", "SELECT stay_id, count(*) AS n FROM (SELECT stay_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM (SELECT DISTINCT stay_id, intime + INTERVAL 24 HOUR AS a, least(outtime, intime + INTERVAL 96 HOUR) AS b FROM icustays WHERE outtime IS NOT NULL) WHERE b >= a) GROUP BY stay_id")
def los_band(s: S, sf: str) -> DF:
    return C.icu_long_stay_path(table(s, sf, "icustays")).groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"))


@R.add("mortality_every_10h", f"""WITH i AS (SELECT DISTINCT stay_id, hadm_id, intime, outtime FROM icustays WHERE outtime > intime), a AS (SELECT hadm_id, max(deathtime) AS death FROM admissions GROUP BY hadm_id),
p AS (SELECT stay_id, outtime, death, intime + INTERVAL 1 HOUR AS a, least(outtime, coalesce(death, outtime)) AS b FROM i LEFT JOIN a ON a.hadm_id = i.hadm_id),
t AS (SELECT stay_id, outtime, death, unnest(generate_series(a, b, INTERVAL 10 HOUR)) AS t FROM p WHERE b >= a)
SELECT stay_id, {at('t')} AS t, coalesce(death <= t + INTERVAL 24 HOUR AND death <= outtime, false) AS label FROM t""")
def mortality_every_10h(s: S, sf: str) -> DF:
    deaths = table(s, sf, "admissions").groupBy("hadm_id").agg(F.max("deathtime").alias("death"))
    return C.icu_mortality(table(s, sf, "icustays"), deaths).withColumn("t", stamp("t"))


@R.add("random_timepoint_hash", f"SELECT DISTINCT stay_id, CAST(floor({_U('tp', 'stay_id')} * greatest(floor(hosp_stay_hours), 1)) AS BIGINT) AS hour_idx FROM stay_to_ids_dict WHERE hosp_stay_hours IS NOT NULL")
def random_timepoint_hash(s: S, sf: str) -> DF:
    return C.random_hours(table(s, sf, "stay_to_ids_dict"), "stay_id", "hosp_stay_hours", "tp")


@R.add("future_24h_window", f"WITH {READINGS}, p AS (SELECT DISTINCT stay_id, intime AS t FROM icustays WHERE intime IS NOT NULL) SELECT p.stay_id, itemid, count(*) AS n FROM p JOIN readings r ON r.stay_id = p.stay_id AND r.charttime > p.t AND r.charttime <= p.t + INTERVAL 26 HOUR GROUP BY p.stay_id, p.t, itemid")
def future_24h_window(s: S, sf: str) -> DF:
    p = table(s, sf, "icustays").where("intime IS NOT NULL").select("stay_id", F.col("intime").alias("t")).distinct()
    f = C.future(readings(s, sf).select("stay_id", "itemid", "charttime"), p, ["stay_id"], "charttime", 24, 2)
    return f.groupBy("stay_id", "t", "itemid").agg(F.count(F.lit(1)).alias("n")).drop("t")


_ED = "SELECT DISTINCT stay_id, CASE WHEN disposition = 'ADMITTED' THEN 1 ELSE 0 END AS label FROM ed_stays WHERE disposition IS NOT NULL"


def _ed(s: S, sf: str) -> DF:
    return table(s, sf, "ed_stays").where("disposition IS NOT NULL").select("stay_id", (F.col("disposition") == "ADMITTED").cast("int").alias("label")).distinct()


@R.add("fixed_500_balanced", f"WITH d AS ({_ED}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_U('fixed', 'stay_id')}, stay_id) AS rn FROM d), k AS (SELECT least(250, min(n)) AS k FROM (SELECT count(*) AS n FROM d GROUP BY label)) SELECT stay_id, label FROM r, k WHERE rn <= k")
def fixed_500_balanced(s: S, sf: str) -> DF:
    return X.balance(_ed(s, sf), "label", ["stay_id"], "fixed", cap=250)


_SECTIONS = [("Vitals", "ICU.2400"), ("Airway", "ICU.2402"), ("Labs", "ICU.2406"), ("Other", "ICU.2407")]
_DIM = ", ".join(f"('{a}', '{b}')" for a, b in _SECTIONS)


@R.add("section_presence", f"SELECT DISTINCT stay_id, section FROM (SELECT DISTINCT stay_id, 'ICU.' || itemid::VARCHAR AS path FROM chartevents WHERE stay_id IS NOT NULL) f JOIN (VALUES {_DIM}) d(section, prefix) ON starts_with(path, prefix)")
def section_presence(s: S, sf: str) -> DF:
    f = table(s, sf, "chartevents").where("stay_id IS NOT NULL").select("stay_id", F.concat(F.lit("ICU."), F.col("itemid").cast("string")).alias("path")).distinct()
    return C.sections_of(f, s.createDataFrame(_SECTIONS, "section string, prefix string"), ["stay_id"], "path")


@R.add("section_changed_empty", f"WITH {READINGS}, h AS (SELECT stay_id, itemid, hour, max(v) AS v FROM readings WHERE itemid IS NOT NULL GROUP BY 1, 2, 3), g AS (SELECT * FROM (SELECT DISTINCT stay_id, hour FROM h) JOIN (SELECT DISTINCT stay_id, itemid FROM h) USING (stay_id)), l AS (SELECT g.*, v, lag(v) OVER (PARTITION BY g.stay_id, g.itemid ORDER BY g.hour) AS old FROM g LEFT JOIN h ON h.stay_id = g.stay_id AND h.itemid = g.itemid AND h.hour = g.hour) SELECT stay_id, itemid, {at('hour')} AS hour, CASE WHEN v IS NULL THEN 'empty' WHEN v IS DISTINCT FROM old THEN 'changed' ELSE 'same' END AS section FROM l")
def section_changed_empty(s: S, sf: str) -> DF:
    """Of every item of a stay, at each of its hours: no reading, one other than the hour before, or the same."""
    h = readings(s, sf).where("itemid IS NOT NULL").groupBy("stay_id", "itemid", "hour").agg(F.max("v").alias("v"))
    g = h.select("stay_id", "hour").distinct().join(h.select("stay_id", "itemid").distinct(), "stay_id")
    l = g.join(h, ["stay_id", "itemid", "hour"], "left").withColumn("old", F.lag("v").over(Window.partitionBy("stay_id", "itemid").orderBy("hour")))  # noqa: E741
    return l.select("stay_id", "itemid", stamp("hour").alias("hour"), F.when(F.col("v").isNull(), "empty").when(~F.col("v").eqNullSafe(F.col("old")), "changed").otherwise("same").alias("section"))


# -- sampling ---------------------------------------------------------------------------------------------------------------
_RARE = """f AS (SELECT DISTINCT stay_id, itemid FROM chartevents WHERE stay_id IS NOT NULL), c AS (SELECT itemid, count(*) AS n FROM f GROUP BY itemid),
w AS (SELECT itemid, greatest(-ln(n::DOUBLE / (SELECT max(n) FROM c) + 1e-10), 0.0) AS w FROM c), p AS (SELECT stay_id, pow(avg(pow(w, 3.0)), 1 / 3.0) AS raw FROM f JOIN w USING (itemid) GROUP BY stay_id), rw AS (SELECT stay_id, raw / (SELECT sum(raw) FROM p) AS weight FROM p)"""


def _rare(s: S, sf: str) -> DF:
    f = table(s, sf, "chartevents").where("stay_id IS NOT NULL").select("stay_id", "itemid").distinct()
    return X.rarity_weights(f, ["stay_id"], "itemid").select("stay_id", "weight")


@R.add("rarity_weights", f"WITH {_RARE} SELECT stay_id, round(weight, 8) AS weight FROM rw")
def rarity_weights(s: S, sf: str) -> DF:
    return _rare(s, sf).withColumn("weight", F.round("weight", 8))


@R.add("weighted_no_replacement", f"WITH {_RARE} SELECT stay_id FROM rw WHERE weight > 0 ORDER BY -ln({_U('es', 'stay_id')}) / weight, stay_id LIMIT 40")
def weighted_no_replacement(s: S, sf: str) -> DF:
    return X.weighted_without_replacement(_rare(s, sf), ["stay_id"], "weight", 40, "es").select("stay_id")


@R.add("uniform_no_replacement", f"SELECT subject_id FROM (SELECT DISTINCT subject_id FROM omr) ORDER BY {_U('uni', 'subject_id')}, subject_id LIMIT 100")
def uniform_no_replacement(s: S, sf: str) -> DF:
    return X.uniform_without_replacement(table(s, sf, "omr").select("subject_id").distinct(), ["subject_id"], 100, "uni")


@R.add("uniform_fraction", f"SELECT doc_id FROM documents WHERE {_U('tenth', 'doc_id')} < 0.1")
def uniform_fraction(s: S, sf: str) -> DF:
    return X.uniform_fraction(table(s, sf, "documents").select("doc_id"), ["doc_id"], 0.1, "tenth")


@R.add("weighted_with_replacement")
def weighted_with_replacement(s: S, sf: str) -> DF:
    return X.weighted_with_replacement(_rare(s, sf), "stay_id", "weight", 500, "wr")


@R.add("balance_minority", f"WITH d AS ({_ED}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_U('bal', 'stay_id')}, stay_id) AS rn FROM d), k AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM d GROUP BY label)) SELECT stay_id, label FROM r, k WHERE rn <= k")
def balance_minority(s: S, sf: str) -> DF:
    return X.balance(_ed(s, sf), "label", ["stay_id"], "bal")


@R.add("inverse_prevalence", "WITH t AS (SELECT count(DISTINCT doc_id) AS t FROM subject_labels), w AS (SELECT subject_area, ln(1 + (t - count(*)) / (count(*) + 1e-5)) AS w FROM subject_labels, t GROUP BY subject_area, t) SELECT doc_id, round(avg(w), 6) AS weight FROM subject_labels JOIN w USING (subject_area) GROUP BY doc_id")
def inverse_prevalence(s: S, sf: str) -> DF:
    return X.inverse_prevalence(table(s, sf, "subject_labels"), "doc_id", "subject_area").withColumn("weight", F.round("weight", 6))


@R.add("log_weight_sections", "WITH g AS (SELECT itemid, count(*) AS n FROM chartevents GROUP BY itemid) SELECT itemid, n, round(ln(n) / (SELECT sum(ln(n)) FROM g), 8) AS p FROM g")
def log_weight_sections(s: S, sf: str) -> DF:
    return X.log_group_weights(table(s, sf, "chartevents"), "itemid").withColumn("p", F.round("p", 8))


@R.add("drop_keys_hash", f"WITH e AS (SELECT stay_id, timepoint, unnest(map_keys(lab_results)) AS k FROM (SELECT DISTINCT stay_id, timepoint, lab_results FROM patient_yaml)), u AS (SELECT *, {_U('drop', 'stay_id', 'timepoint', 'k')} AS u FROM e), m AS (SELECT *, row_number() OVER (PARTITION BY stay_id, timepoint ORDER BY u DESC, k DESC) AS rd FROM u) SELECT stay_id, timepoint, string_agg(DISTINCT k, ',' ORDER BY k) AS kept FROM m WHERE u >= 0.3 OR rd = 1 GROUP BY stay_id, timepoint")
def drop_keys_hash(s: S, sf: str) -> DF:
    y = table(s, sf, "patient_yaml")
    kept = X.drop_entries(F.col("lab_results"), F.concat_ws("|", "stay_id", F.col("timepoint").cast("string")), 0.3, "drop")
    k = y.select("stay_id", "timepoint", F.explode(F.map_keys(kept)).alias("k")).distinct()
    return k.groupBy("stay_id", "timepoint").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("kept"))


@R.add("augment_choice", f"SELECT doc_id, CASE WHEN {_U('aug', 'doc_id')} < 0.33 THEN 'text' WHEN {_U('aug', 'doc_id')} < 0.33 + 0.33 THEN 'summary' ELSE 'both' END AS mode FROM documents")
def augment_choice(s: S, sf: str) -> DF:
    return table(s, sf, "documents").select("doc_id", X.choose(F.col("doc_id"), "aug", [("text", 0.33), ("summary", 0.33), ("both", 0.34)]).alias("mode"))


# -- metrics ------------------------------------------------------------------------------------------------------------------
_SETS = f"""{READINGS}, b AS (SELECT stay_id, min(hour) AS a FROM readings GROUP BY stay_id),
g AS (SELECT DISTINCT r.stay_id, itemid FROM readings r JOIN b ON b.stay_id = r.stay_id WHERE hour < a + INTERVAL 6 HOUR), p AS (SELECT DISTINCT r.stay_id, itemid FROM readings r JOIN b ON b.stay_id = r.stay_id WHERE hour >= a + INTERVAL 6 HOUR AND hour < a + INTERVAL 12 HOUR),
c AS (SELECT coalesce(g.itemid, p.itemid) AS itemid, count(*) FILTER (g.itemid IS NOT NULL AND p.itemid IS NOT NULL) AS tp, count(*) FILTER (g.itemid IS NULL) AS fp, count(*) FILTER (p.itemid IS NULL) AS fn FROM g FULL JOIN p ON g.stay_id = p.stay_id AND g.itemid = p.itemid GROUP BY 1)"""


def _counts(s: S, sf: str) -> DF:
    r = readings(s, sf)
    r = r.join(r.groupBy("stay_id").agg(F.min("hour").alias("a")), "stay_id")
    h = hours_between("a", "hour")
    return M.event_sets(r.where(h < 6).withColumn("item", F.col("itemid")), r.where((h >= 6) & (h < 12)).withColumn("item", F.col("itemid")), ["stay_id"], "item", ["itemid"])


_PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END"
_REC = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END"
_F1 = "CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0 END"


@R.add("event_prf", f"WITH {_SETS} SELECT itemid, tp, fp, fn, round({_PRF}, 6) AS precision, round({_REC}, 6) AS recall, round({_F1}, 6) AS f1 FROM c")
def event_prf(s: S, sf: str) -> DF:
    p, r, f = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return _counts(s, sf).select("itemid", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


@R.add("macro_micro", f"WITH {_SETS} SELECT round(avg({_F1}), 6) AS macro_f1, round(2.0 * sum(tp) / (2.0 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM c")
def macro_micro(s: S, sf: str) -> DF:
    m = M.macro_micro(_counts(s, sf))
    return m.select(F.round("macro_f1", 6).alias("macro_f1"), F.round("micro_f1", 6).alias("micro_f1"))


_TWO = f"WITH d AS (SELECT hadm_id, list(DISTINCT {icd_chapter_sql('trim(icd_code)')}) AS a, list(DISTINCT {icd_chapter_sql('trim(icd_code)')}) FILTER (seq_num <= 3) AS b FROM diagnoses_icd WHERE trim(icd_version) = '9' GROUP BY hadm_id), x AS (SELECT area, coalesce(list_contains(a, area), false) AS g, coalesce(list_contains(b, area), false) AS p FROM d, (SELECT unnest([{', '.join(repr(n) for n in _NAMES)}]) AS area)), c AS (SELECT area, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM x GROUP BY area)"


def _two(s: S, sf: str) -> DF:
    """Per admission and class of diagnoses whether it is among its codes (g), and whether among its first three (p), taken as a guess."""
    c = icd_chapter(F.trim("icd_code"))
    d = table(s, sf, "diagnoses_icd").where(F.trim("icd_version") == "9").groupBy("hadm_id").agg(F.collect_set(c).alias("a"), F.collect_set(F.when(F.col("seq_num") <= 3, c)).alias("b"))
    v = F.explode(F.array(*[F.lit(n) for n in _NAMES]))
    return d.select("a", "b", v.alias("area")).select("area", F.array_contains("a", F.col("area")).alias("g"), F.array_contains("b", F.col("area")).alias("p"))


@R.add("list_prf_tn", _TWO + " SELECT * FROM c")
def list_prf_tn(s: S, sf: str) -> DF:
    return _two(s, sf).groupBy("area").agg(*[c.alias(n) for n, c in M.confusion(F.col("g"), F.col("p")).items()])


@R.add("multilabel_report", _TWO + f" SELECT area, round({_PRF}, 6) AS precision, round({_REC}, 6) AS recall, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc FROM c WHERE tp + fn > 0 AND tn + fp > 0")
def multilabel_report(s: S, sf: str) -> DF:
    d = _two(s, sf).withColumn("p", F.col("p").cast("int"))
    c = d.groupBy("area").agg(*[c.alias(n) for n, c in M.confusion(F.col("g"), F.col("p") == 1).items()])
    p, r, _ = M.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.join(M.auc_by_rank(d, ["area"], "g", "p"), "area").where(~F.isnan("auc")).select("area", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round("auc", 6).alias("auc"))


_BIN = "WITH d AS (SELECT DISTINCT stay_id, disposition = 'ADMITTED' AS g, ed_stay_hours AS s FROM ed_stays WHERE disposition IS NOT NULL AND ed_stay_hours IS NOT NULL)"


@R.add("binary_metrics_auc", _BIN + ", r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d) SELECT round(count(*) FILTER (g = (s > 6)) / count(*), 6) AS accuracy, round((sum(rk) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0) / (count(*) FILTER (g) * count(*) FILTER (NOT g)), 6) AS auc FROM r")
def binary_metrics_auc(s: S, sf: str) -> DF:
    d = table(s, sf, "ed_stays").where("disposition IS NOT NULL AND ed_stay_hours IS NOT NULL").select("stay_id", (F.col("disposition") == "ADMITTED").alias("g"), F.col("ed_stay_hours").alias("s")).distinct()
    acc = d.agg(F.round(F.count_if(F.col("g") == (F.col("s") > 6)) / F.count(F.lit(1)), 6).alias("accuracy"))
    return acc.transform(attach, M.auc_by_rank(d, [], "g", "s").select(F.round("auc", 6).alias("auc")))


_ALN = f"{READINGS}, g AS (SELECT stay_id, itemid, hour, avg(v) AS gt FROM readings WHERE v IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT stay_id, itemid, hour + INTERVAL 1 HOUR AS hour, gt AS pred FROM g), q AS (SELECT itemid, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM readings WHERE v IS NOT NULL GROUP BY itemid), j AS (SELECT itemid, gt, pred, lo, hi FROM (SELECT * FROM g FULL JOIN p USING (stay_id, itemid, hour)) JOIN q USING (itemid)), w AS (SELECT itemid, coalesce(gt, lo) AS gt, coalesce(pred, CASE WHEN abs(gt - lo) >= abs(gt - hi) THEN lo ELSE hi END) AS pred, lo, hi FROM j)"


def _aligned(s: S, sf: str) -> DF:
    r = readings(s, sf).where("v IS NOT NULL AND itemid IS NOT NULL")
    g = r.groupBy("stay_id", "itemid", "hour").agg(F.avg("v").alias("gt"))
    p = g.select("stay_id", "itemid", (F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("hour"), F.col("gt").alias("pred"))
    q = r.groupBy("itemid").agg(F.percentile("v", F.lit(0.01)).alias("lo"), F.percentile("v", F.lit(0.99)).alias("hi"))
    return M.worst_case(join_dimension(g.join(p, ["stay_id", "itemid", "hour"], "full_outer"), q, ["itemid"]), "gt", "pred", "lo", "hi")


@R.add("rmse_mae_worst_case", f"WITH {_ALN} SELECT itemid, round(sqrt(avg(pow(gt - pred, 2))), 4) AS rmse, round(avg(abs(gt - pred)), 4) AS mae, count(*) AS n FROM w GROUP BY itemid")
def rmse_mae_worst_case(s: S, sf: str) -> DF:
    a, b = M.regression(F.col("gt"), F.col("pred"))
    return _aligned(s, sf).groupBy("itemid").agg(F.round(a, 4).alias("rmse"), F.round(b, 4).alias("mae"), F.count(F.lit(1)).alias("n"))


@R.add("clip_minmax_normalize", f"WITH {_ALN}, x AS (SELECT itemid, (greatest(lo, least(hi, gt)) - lo) / (hi - lo) AS a, (greatest(lo, least(hi, pred)) - lo) / (hi - lo) AS b FROM w WHERE hi > lo) SELECT itemid, round(sqrt(avg(pow(a - b, 2))), 6) AS rmse, round(min(a), 6) AS least, round(max(a), 6) AS most FROM x GROUP BY itemid")
def clip_minmax_normalize(s: S, sf: str) -> DF:
    x = _aligned(s, sf).where("hi > lo").select("itemid", min_max(F.col("gt"), F.col("lo"), F.col("hi")).alias("a"), min_max(F.col("pred"), F.col("lo"), F.col("hi")).alias("b"))
    return x.groupBy("itemid").agg(F.round(M.regression(F.col("a"), F.col("b"))[0], 6).alias("rmse"), F.round(F.min("a"), 6).alias("least"), F.round(F.max("a"), 6).alias("most"))


@R.add("accuracy_unknown", "WITH e AS (SELECT stay_id, max(disposition) AS d FROM ed_stays GROUP BY stay_id), p AS (SELECT stay_id, CASE WHEN max(ed_stay_hours) > 6 THEN 'ADMITTED' ELSE 'HOME' END AS d FROM ed_stays WHERE ed_stay_hours IS NOT NULL GROUP BY stay_id) SELECT round(count(*) FILTER (coalesce(e.d, 'UNKNOWN') = coalesce(p.d, 'UNKNOWN')) / count(*), 6) AS accuracy, count(*) AS n FROM e FULL JOIN p USING (stay_id)")
def accuracy_unknown(s: S, sf: str) -> DF:
    e = table(s, sf, "ed_stays")
    p = e.where("ed_stay_hours IS NOT NULL").groupBy("stay_id").agg(F.when(F.max("ed_stay_hours") > 6, "ADMITTED").otherwise("HOME").alias("p"))
    j = e.groupBy("stay_id").agg(F.max("disposition").alias("d")).join(p, "stay_id", "full_outer")
    return j.agg(F.round(M.accuracy(F.col("d"), F.col("p")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@R.add("baseline_mean_majority", f"WITH {READINGS} SELECT itemid, CASE WHEN count(v) > 0 THEN {text_sql('round(avg(v), 6)')} ELSE (SELECT x.value FROM readings x WHERE x.itemid = r.itemid AND x.value IS NOT NULL GROUP BY x.value ORDER BY count(*) DESC, x.value LIMIT 1) END AS value FROM readings r GROUP BY itemid")
def baseline_mean_majority(s: S, sf: str) -> DF:
    r = readings(s, sf).withColumn("x", F.when(F.col("v").isNull(), F.col("value")))
    num = r.groupBy("itemid").agg(F.avg("v").alias("m"))
    n = r.where("x IS NOT NULL").groupBy("itemid", "x").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("itemid").agg(F.min_by("x", F.struct(-F.col("n"), F.col("x"))).alias("top"))
    return num.join(top, "itemid", "left").select("itemid", F.coalesce(text_of(F.round("m", 6)), "top").alias("value"))


@R.add("baseline_frequency_hash", f"WITH {_RARE}, n AS (SELECT count(DISTINCT stay_id) AS n FROM f), q AS (SELECT itemid, c.n::DOUBLE / n.n AS p FROM c, n), s AS (SELECT DISTINCT stay_id FROM f) SELECT stay_id, count(*) AS events FROM s, q WHERE {_U('bern', 'stay_id', 'itemid')} < p GROUP BY stay_id")
def baseline_frequency_hash(s: S, sf: str) -> DF:
    """Each event of the fixed item list predicted for a stay with the probability with which it occurs; one row per stay."""
    f = table(s, sf, "chartevents").where("stay_id IS NOT NULL").select("stay_id", "itemid").distinct()
    n = f.agg(F.countDistinct("stay_id").alias("n"))
    q = f.groupBy("itemid").agg(F.count(F.lit(1)).alias("c")).transform(attach, n).select("itemid", (F.col("c") / F.col("n")).alias("p"))
    items = q.agg(F.array_sort(F.collect_list(F.struct("itemid", "p"))).alias("items"))  # one entry per item of the dictionary
    g = f.select("stay_id").distinct().transform(attach, items).select("stay_id", F.explode("items").alias("i"))
    u = uniform(F.concat_ws("|", F.lit("bern"), F.col("stay_id").cast("string"), F.col("i.itemid").cast("string")))
    return g.where(u < F.col("i.p")).groupBy("stay_id").agg(F.count(F.lit(1)).alias("events"))


_GRAMS = " UNION ALL ".join(f"SELECT id, {k} AS k, '{s}' AS side, array_to_string({s}[i:i + {k - 1}], ' ') AS g FROM d, unnest(range(1, len({s}) - {k} + 2)) AS u(i)" for k in range(1, 5) for s in "rc")


@R.add("corpus_bleu", r"WITH d AS (SELECT row_number() OVER () AS id, regexp_split_to_array(lower(trim(text)), '\s+') AS r, regexp_split_to_array(lower(trim(regexp_replace(text, '\d+', '0', 'g'))), '\s+') AS c FROM documents WHERE text IS NOT NULL), g AS (" + _GRAMS + "), n AS (SELECT id, k, g, count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 'c') AS c FROM g GROUP BY ALL), p AS (SELECT k, sum(least(r, c)) AS hit, sum(c) AS total FROM n GROUP BY k), l AS (SELECT sum(len(r)) AS r, sum(len(c)) AS c FROM d) SELECT round((SELECT CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c) END FROM l) * exp(sum(ln(hit / total)) / 4), 6) AS bleu FROM p")
def corpus_bleu(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").where("text IS NOT NULL").select("text", F.regexp_replace("text", r"\d+", "0").alias("other"))
    return M.corpus_bleu(d, "text", "other").select(F.round("bleu", 6).alias("bleu"))


# -- budgets, prompts, embeddings -----------------------------------------------------------------------------------------------
@R.add("water_filling_budget", "WITH l AS (SELECT hadm_id, list(length(text)::BIGINT ORDER BY length(text)) AS ls FROM documents WHERE hadm_id IS NOT NULL AND text IS NOT NULL GROUP BY hadm_id) SELECT hadm_id, CASE WHEN list_sum(ls) <= 1500 THEN ls[-1] ELSE list_max(list_transform(range(0, len(ls)), lambda k: CASE WHEN (k = 0 OR ls[k] <= floor((1500 - coalesce(list_sum(ls[1:k]), 0)) / (len(ls) - k))) AND floor((1500 - coalesce(list_sum(ls[1:k]), 0)) / (len(ls) - k)) < ls[k + 1] THEN floor((1500 - coalesce(list_sum(ls[1:k]), 0)) / (len(ls) - k)) END))::BIGINT END AS level FROM l")
def water_filling_budget(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").where("hadm_id IS NOT NULL AND text IS NOT NULL").groupBy("hadm_id").agg(F.collect_list(F.length("text")).alias("ls"))
    return d.select("hadm_id", B.level(F.col("ls"), F.lit(1500)).alias("level"))


@R.add("tail_truncate", "SELECT doc_id, right(text, 300) AS tail FROM documents WHERE text IS NOT NULL")
def tail_truncate(s: S, sf: str) -> DF:
    return table(s, sf, "documents").where("text IS NOT NULL").select("doc_id", B.shorten(F.array("text"), F.lit(300))[0].alias("tail"))


@R.add("split_parts", "WITH d AS (SELECT hadm_id, doc_id, floor((sum(length(text)) OVER (PARTITION BY hadm_id ORDER BY doc_id) - 1) / 1200)::BIGINT AS part FROM documents WHERE hadm_id IS NOT NULL AND text <> '') SELECT hadm_id, doc_id, part FROM (SELECT *, max(part) OVER (PARTITION BY hadm_id) AS m FROM d) WHERE part > m - 4")
def split_parts(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").where("hadm_id IS NOT NULL AND text <> ''").select("hadm_id", "doc_id", F.length("text").alias("n"))
    return B.split_parts(d, ["hadm_id"], "doc_id", "n", 1200).select("hadm_id", "doc_id", "part")


@R.add("budget_drop", f"""WITH e AS (SELECT stay_id, timepoint, unnest(map_keys(lab_results)) AS k FROM (SELECT DISTINCT stay_id, timepoint, map_from_entries(list_sort(map_entries(lab_results))) AS lab_results FROM patient_yaml)),
g AS (SELECT DISTINCT stay_id, timepoint, k FROM e), o AS (SELECT *, count(*) OVER (PARTITION BY stay_id, timepoint) AS n, row_number() OVER w AS i, sum(length(k)) OVER (w ROWS UNBOUNDED PRECEDING) AS c FROM g WINDOW w AS (PARTITION BY stay_id, timepoint ORDER BY {_U('fit', 'stay_id', 'timepoint', 'k')}, k)),
f AS (SELECT *, coalesce(max(CASE WHEN c <= 40 THEN i END) OVER (PARTITION BY stay_id, timepoint), 0) AS fit FROM o),
r AS (SELECT *, list_min(list_filter(range(0, 11), lambda x: ceil(n * (10 - x) / 10.0) <= fit)) AS r FROM f)
SELECT stay_id, timepoint, string_agg(k, ',' ORDER BY k) AS kept FROM r WHERE i <= greatest(ceil(n * (10 - coalesce(r, 10)) / 10.0), 1) GROUP BY stay_id, timepoint""")
def budget_drop(s: S, sf: str) -> DF:
    e = table(s, sf, "patient_yaml").select("stay_id", "timepoint", F.explode(F.map_keys("lab_results")).alias("k")).distinct().withColumn("n", F.length("k"))
    d = B.drop_to_budget(e, ["stay_id", "timepoint"], "k", "n", 40, "fit")
    return d.groupBy("stay_id", "timepoint").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("kept"))


@R.add("chat_prompt_text", "SELECT doc_id, '<|system|>' || chr(10) || lower(trim(source)) || chr(10) || '<|user|>' || chr(10) || text || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def chat_prompt_text(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return d.select("doc_id", B.chat_prompt(F.array(F.lit("system"), F.lit("user")), F.array(F.lower(F.trim("source")), F.col("text")), generate=True).alias("prompt"))


@R.add("embedding_clamp_int8", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: trunc(greatest(-128.0, least(127.0, x::DOUBLE * 400)))::INT))::BIGINT AS total, list_min(list_transform(embedding, lambda x: trunc(greatest(-128.0, least(127.0, x::DOUBLE * 400)))::INT))::BIGINT AS least FROM embeddings")
def embedding_clamp_int8(s: S, sf: str) -> DF:
    v = B.clamp_int8(F.transform("embedding", lambda x: x.cast("double") * 400))
    return table(s, sf, "embeddings").select("vec_id", F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_min(v).cast("bigint").alias("least"))


@R.add("embedding_group", "SELECT label, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY label")
def embedding_group(s: S, sf: str) -> DF:
    g = table(s, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("vec_id")).alias("v"))
    return g.select("label", "n", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("ids"))


@R.add("embedding_tail_slice", "SELECT vec_id, round(list_sum(list_transform(embedding[len(embedding) - 9:len(embedding) - 2], lambda x: x::DOUBLE)) * 100000)::BIGINT AS s FROM embeddings")
def embedding_tail_slice(s: S, sf: str) -> DF:
    v = F.transform(B.summary_slice(F.col("embedding")), lambda x: x.cast("double"))
    return table(s, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) * 100000).cast("bigint").alias("s"))


@R.add("length_sorted_blocks", "WITH r AS (SELECT doc_id, coalesce(length(text), 0) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS block_no FROM documents) SELECT doc_id, block_no, row_number() OVER (PARTITION BY block_no ORDER BY n DESC, doc_id) AS place FROM r")
def length_sorted_blocks(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return B.length_blocks(d, "doc_id", "n", "doc_id").select("doc_id", "block_no", F.col("place").cast("bigint").alias("place"))


@R.add("worker_shards", "SELECT subject_id, ntile(16) OVER (ORDER BY subject_id) - 1 AS worker FROM (SELECT DISTINCT subject_id FROM omr WHERE subject_id IS NOT NULL)")
def worker_shards(s: S, sf: str) -> DF:
    return B.worker_shards(table(s, sf, "omr"), "subject_id", 16)


@R.add("head_limits", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100) UNION ALL SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 100)")
def head_limits(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").select("doc_id")
    return d.orderBy("doc_id").limit(100).union(d.orderBy(F.col("doc_id").desc()).limit(100))


@R.add("simulate_stub")
def simulate_stub(s: S, sf: str) -> DF:
    """Stays rolled forward from their last reading, the last value of every item carried, until discharge or 24 steps."""
    r = readings(s, sf).where("v IS NOT NULL")
    last = r.groupBy("stay_id", "itemid").agg(F.max("hour").alias("h"), F.max_by("v", F.struct("charttime", "v")).alias("v"))
    start = last.join(last.groupBy("stay_id").agg(F.max("h").alias("t")), "stay_id").drop("h")
    ends = table(s, sf, "icustays").groupBy("stay_id").agg(F.max("outtime").alias("end_at"))
    state = start.join(ends, "stay_id", "left")
    carry = lambda st: st.select("stay_id", "itemid", F.col("v"), (F.col("t") + F.expr("INTERVAL 1 HOUR") >= F.col("end_at")).alias("over"))
    return simulate(state, ["stay_id", "itemid"], carry, max_steps=24).select("stay_id", "itemid", stamp("t").alias("t"), "v", "steps", "ended_by")

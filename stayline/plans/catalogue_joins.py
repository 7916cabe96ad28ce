"""Join and aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.operators.common import attach
from stayline.functions.numeric import to_number
from stayline.functions.time import hour_round, stamp
from stayline.operators import aggregates as A
from stayline.operators import joins as J
from stayline.plans.registry import Registry, table
from stayline.plans.sql import READINGS, at, hour, num

R = Registry()
DF, S = DataFrame, SparkSession


def readings(s: S, sf: str) -> DF:
    """Chart readings on the hour grid: stay_id, itemid, hour, charttime, v, value."""
    c = table(s, sf, "chartevents").where("stay_id IS NOT NULL AND charttime IS NOT NULL")
    return c.select("stay_id", "itemid", hour_round("charttime").alias("hour"), "charttime", to_number(F.col("valuenum")).alias("v"), "value")


@R.add("natural_left_core", "SELECT o_orderkey, o_custkey, c_name, c_nationkey, n_name, n_regionkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def natural_left_core(s: S, sf: str) -> DF:
    o = table(s, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(s, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(s, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return J.natural_left(J.natural_left(o, c), F.broadcast(n))


@R.add("stay_core", "SELECT DISTINCT a.subject_id, a.hadm_id, t.transfer_id::VARCHAR AS transfer_id, t.careunit FROM admissions a LEFT JOIN transfers t ON a.subject_id IS NOT DISTINCT FROM t.subject_id AND a.hadm_id IS NOT DISTINCT FROM t.hadm_id")
def stay_core(s: S, sf: str) -> DF:
    a = table(s, sf, "admissions").select("subject_id", "hadm_id").distinct()
    t = table(s, sf, "transfers").select("subject_id", "hadm_id", "transfer_id", "careunit").distinct()
    return J.natural_left(a, t).withColumn("transfer_id", F.col("transfer_id").cast("string"))


@R.add("dictionary_broadcast", "WITH d AS (SELECT trim(icd_code) AS code, trim(icd_version) AS version, min(long_title) AS title FROM d_icd_diagnoses GROUP BY 1, 2) SELECT hadm_id, seq_num, trim(icd_code) AS code, trim(icd_version) AS version, title FROM diagnoses_icd x LEFT JOIN d ON d.code = trim(x.icd_code) AND d.version = trim(x.icd_version)")
def dictionary_broadcast(s: S, sf: str) -> DF:
    keys = [F.trim("icd_code").alias("code"), F.trim("icd_version").alias("version")]
    d = table(s, sf, "d_icd_diagnoses").select(*keys, "long_title").groupBy("code", "version").agg(F.min("long_title").alias("title"))
    return J.with_dictionary(table(s, sf, "diagnoses_icd").select("hadm_id", "seq_num", *keys), d, ["code", "version"])


@R.add("inner_code_map", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 25")
def inner_code_map(s: S, sf: str) -> DF:
    p = table(s, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey").drop("l_partkey")


@R.add("semi_detail", "SELECT stay_id, itemid, count(*) AS n FROM chartevents WHERE stay_id IN (SELECT stay_id FROM icustays WHERE first_careunit LIKE 'Medical%') GROUP BY stay_id, itemid")
def semi_detail(s: S, sf: str) -> DF:
    keep = table(s, sf, "icustays").where("first_careunit LIKE 'Medical%'").select("stay_id").distinct()
    return table(s, sf, "chartevents").select("stay_id", "itemid").join(keep, "stay_id", "left_semi").groupBy("stay_id", "itemid").agg(F.count(F.lit(1)).alias("n"))


@R.add("anti_addendum", "SELECT doc_id, hadm_id::VARCHAR AS hadm_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM admissions a WHERE a.hadm_id = d.hadm_id)")
def anti_addendum(s: S, sf: str) -> DF:
    a = table(s, sf, "admissions").select("hadm_id").dropna().distinct()
    return table(s, sf, "documents").select("doc_id", "hadm_id").join(a, "hadm_id", "left_anti").select("doc_id", F.col("hadm_id").cast("string").alias("hadm_id"))


@R.add("self_join_concat", f"WITH d AS (SELECT hadm_id, author_id, lower(trim(source)) AS kind, doc_id, text, charttime, first_value(doc_id) OVER (PARTITION BY hadm_id, author_id, lower(trim(source)) ORDER BY charttime, doc_id) AS parent FROM documents WHERE hadm_id IS NOT NULL AND author_id IS NOT NULL AND charttime IS NOT NULL AND source IS NOT NULL), a AS (SELECT parent, string_agg(text, chr(10) ORDER BY charttime, doc_id) AS more FROM d WHERE doc_id <> parent AND text IS NOT NULL GROUP BY parent), j AS (SELECT d.doc_id, coalesce(text, '') || CASE WHEN more IS NULL THEN '' ELSE chr(10) || more END AS t FROM d LEFT JOIN a ON a.parent = d.doc_id WHERE d.doc_id = d.parent) SELECT doc_id, length(t) AS n, md5(t) AS joined FROM j")
def self_join_concat(s: S, sf: str) -> DF:
    """Documents with the later ones of the same admission, author and source (their addenda) appended in order."""
    d = table(s, sf, "documents").where("hadm_id IS NOT NULL AND author_id IS NOT NULL AND charttime IS NOT NULL AND source IS NOT NULL").select("hadm_id", "author_id", F.lower(F.trim("source")).alias("kind"), "doc_id", "text", "charttime")
    k = ["hadm_id", "author_id", "kind"]
    first = d.groupBy(*k).agg(F.min_by("doc_id", F.struct("charttime", "doc_id")).alias("parent_id"))
    link = d.select(*k, "doc_id").join(first, k).where("doc_id <> parent_id").select("doc_id", "parent_id")
    return J.append_addenda(d.select("doc_id", "text", "charttime"), link, "doc_id", "parent_id", "text", "charttime").select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("joined"))


@R.add("latest_linked", f"SELECT hadm_id, stay_id, {at('intime')} AS intime FROM (SELECT *, row_number() OVER (PARTITION BY hadm_id ORDER BY intime DESC, stay_id DESC) AS rn FROM ed_stays WHERE hadm_id IS NOT NULL AND intime IS NOT NULL) WHERE rn = 1")
def latest_linked(s: S, sf: str) -> DF:
    e = table(s, sf, "ed_stays").where("hadm_id IS NOT NULL").select("hadm_id", "stay_id", "intime")
    return J.latest_per_key(e, ["hadm_id"], "intime", "stay_id").withColumn("intime", stamp("intime"))


_CONTAIN = """
WITH p AS (SELECT DISTINCT hadm_id, transfer_id, intime AS t FROM transfers WHERE hadm_id IS NOT NULL),
i AS (SELECT DISTINCT hadm_id, stay_id, intime, outtime FROM icustays WHERE outtime >= intime),
j AS (SELECT p.transfer_id, p.hadm_id, i.stay_id, row_number() OVER (PARTITION BY p.transfer_id, p.hadm_id, p.t ORDER BY i.intime NULLS LAST, i.stay_id) AS rn
  FROM p LEFT JOIN i ON p.hadm_id = i.hadm_id AND {cond})
SELECT transfer_id, hadm_id, stay_id::VARCHAR AS stay_id FROM j WHERE rn = 1"""


def _contained(s: S, sf: str, strict: bool) -> DF:
    p = table(s, sf, "transfers").where("hadm_id IS NOT NULL").select("hadm_id", "transfer_id", F.col("intime").alias("t")).distinct()
    i = table(s, sf, "icustays").select("hadm_id", "stay_id", "intime", "outtime").distinct()
    return J.within_intervals(p, i, ["hadm_id"], "t", "intime", "outtime", "stay_id", strict).select("transfer_id", "hadm_id", F.col("stay_id").cast("string").alias("stay_id"))


@R.add("interval_containment", _CONTAIN.format(cond="p.t BETWEEN i.intime AND i.outtime"))
def interval_containment(s: S, sf: str) -> DF:
    return _contained(s, sf, False)


@R.add("interval_containment_strict", _CONTAIN.format(cond="i.intime < p.t AND p.t < i.outtime"))
def interval_containment_strict(s: S, sf: str) -> DF:
    return _contained(s, sf, True)


def _sides(s: S, sf: str) -> tuple[DF, DF]:
    """Readings of two items as truth (240179) and prediction (240180), under one key."""
    r = readings(s, sf).where("v IS NOT NULL")
    t = r.where("itemid = 240179").select("stay_id", F.col("charttime").alias("t"), F.col("v")).distinct()
    p = r.where("itemid = 240180").select("stay_id", F.col("charttime").alias("t"), (F.col("v") * 2 - 12).alias("v")).distinct()
    return t, p


_SIDES = f"WITH {READINGS}, t AS (SELECT DISTINCT stay_id, charttime AS t, v FROM readings WHERE itemid = 240179 AND v IS NOT NULL), p AS (SELECT DISTINCT stay_id, charttime AS t, v * 2 - 12 AS v FROM readings WHERE itemid = 240180 AND v IS NOT NULL)"
_NEAR = "t.stay_id = p.stay_id AND abs(epoch_us(t.t) - epoch_us(p.t)) <= 3600000000"


@R.add("tolerant_events", _SIDES + f" SELECT 'tp' AS kind, count(*) AS n FROM t WHERE EXISTS (SELECT 1 FROM p WHERE {_NEAR}) UNION ALL SELECT 'fn', count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE {_NEAR}) UNION ALL SELECT 'fp', count(*) FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE {_NEAR})")
def tolerant_events(s: S, sf: str) -> DF:
    t, p = _sides(s, sf)
    one = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    hit = J.tolerant(t, p, ["stay_id"], "t", 3600, "left_semi")
    return one(hit, "tp").union(one(J.tolerant(t, p, ["stay_id"], "t", 3600, "left_anti"), "fn")).union(one(J.tolerant(p, t, ["stay_id"], "t", 3600, "left_anti"), "fp"))


@R.add("tolerant_nearest_value", _SIDES + f" SELECT stay_id, {at('t')} AS t, v, gt_value FROM (SELECT p.stay_id, p.t, p.v, t.v AS gt_value, row_number() OVER (PARTITION BY p.stay_id, p.t, p.v ORDER BY abs(p.v - t.v), t.t, t.v) AS rn FROM p JOIN t ON {_NEAR}) WHERE rn = 1")
def tolerant_nearest_value(s: S, sf: str) -> DF:
    t, p = _sides(s, sf)
    return J.nearest_value(p, t, ["stay_id"], "t", "v", 3600).select("stay_id", stamp("t").alias("t"), "v", "gt_value")


_WORDS = f"WITH t AS (SELECT DISTINCT stay_id, charttime AS t, value AS v FROM chartevents WHERE itemid = 240048 AND charttime IS NOT NULL AND stay_id IS NOT NULL AND value IS NOT NULL), p AS (SELECT stay_id, t + INTERVAL 30 MINUTE AS t, v FROM t)"


@R.add("tolerant_categorical", _WORDS + f" SELECT p.stay_id, {at('p.t')} AS t, p.v, bool_or(p.v = t.v) AS equal FROM p JOIN t ON t.stay_id = p.stay_id AND t.t BETWEEN p.t - INTERVAL 20 MINUTE AND p.t + INTERVAL 20 MINUTE GROUP BY p.stay_id, p.t, p.v")
def tolerant_categorical(s: S, sf: str) -> DF:
    t = table(s, sf, "chartevents").where("itemid = 240048 AND charttime IS NOT NULL AND stay_id IS NOT NULL AND value IS NOT NULL").select("stay_id", F.col("charttime").alias("t"), F.col("value").alias("v")).distinct()
    p = t.withColumn("t", F.col("t") + F.expr("INTERVAL 30 MINUTES"))
    return J.any_equal(p, t, ["stay_id"], "t", "v", 1200).withColumn("t", stamp("t"))


@R.add("aligned_full_outer", f"WITH {READINGS}, a AS (SELECT stay_id, hour, avg(v) AS v FROM readings WHERE itemid = 240045 AND v IS NOT NULL GROUP BY 1, 2), b AS (SELECT stay_id, hour, avg(v) AS v FROM readings WHERE itemid = 240210 AND v IS NOT NULL GROUP BY 1, 2) SELECT coalesce(a.stay_id, b.stay_id) AS stay_id, {at('coalesce(a.hour, b.hour)')} AS hour, round(coalesce(a.v, -1), 4) AS gt, round(coalesce(b.v, -1), 4) AS pred FROM a FULL JOIN b ON a.stay_id = b.stay_id AND a.hour = b.hour")
def aligned_full_outer(s: S, sf: str) -> DF:
    r = readings(s, sf).where("v IS NOT NULL")
    side = lambda item, name: r.where(F.col("itemid") == item).groupBy("stay_id", "hour").agg(F.avg("v").alias(name))
    j = side(240045, "gt").join(side(240210, "pred"), ["stay_id", "hour"], "full_outer").fillna(-1.0, ["gt", "pred"])
    return j.select("stay_id", stamp("hour").alias("hour"), F.round("gt", 4).alias("gt"), F.round("pred", 4).alias("pred"))


# -- aggregations -----------------------------------------------------------------------------------------------------
#: The charted items. Fixed values.
_PIV = (
    240045, 240048, 240052, 240054, 240074, 240084, 240092, 240120, 240126, 240168, 240179, 240180, 240188, 240210, 240224, 240226, 240277, 240339, 240442, 240545,
    240600, 240602, 240615, 240639, 240645, 240650, 240664, 240695, 240739, 240761, 240765, 240791, 240813, 240835, 240900, 240901, 240986,
)


def _pivot_sql(agg: str) -> str:
    cols = ", ".join(f"max(CASE WHEN itemid = {i} THEN v END) AS i{i}" for i in _PIV)
    return f"WITH {READINGS}, g AS (SELECT stay_id, hour, itemid, {agg} AS v FROM readings WHERE itemid IN {_PIV} GROUP BY ALL) SELECT stay_id, {at('hour')} AS hour, {cols} FROM g GROUP BY stay_id, hour HAVING count(v) > 0"


def _pivot(s: S, sf: str, agg) -> DF:  # noqa: ANN001
    p = A.pivot_points(readings(s, sf).where(F.col("itemid").isin(*_PIV)), ["stay_id", "hour"], "itemid", _PIV, agg, "i")
    return p.withColumn("hour", stamp("hour"))


@R.add("pivot_first", _pivot_sql("arg_min(v, struct_pack(a := charttime, b := v)) FILTER (v IS NOT NULL)"))
def pivot_first(s: S, sf: str) -> DF:
    return _pivot(s, sf, A.first_known(F.col("v"), F.col("charttime"), F.col("v")))


@R.add("pivot_last", _pivot_sql("arg_max(v, struct_pack(a := charttime, b := v)) FILTER (v IS NOT NULL)"))
def pivot_last(s: S, sf: str) -> DF:
    return _pivot(s, sf, A.last_known(F.col("v"), F.col("charttime"), F.col("v")))


@R.add("pivot_sum_zero", _pivot_sql("round(coalesce(sum(v), 0.0), 4)"))
def pivot_sum_zero(s: S, sf: str) -> DF:
    return _pivot(s, sf, F.round(A.sum_or_zero(F.col("v")), 4))


@R.add("pivot_mean", _pivot_sql("round(avg(v), 4)"))
def pivot_mean(s: S, sf: str) -> DF:
    return _pivot(s, sf, F.round(F.avg("v"), 4))


@R.add("mean_or_last", f"WITH {READINGS} SELECT stay_id, itemid, {at('hour')} AS hour, round(avg(v), 4) AS mean, CASE WHEN count(v) = 0 THEN arg_max(value, struct_pack(a := charttime, b := value)) FILTER (value IS NOT NULL) END AS last FROM readings GROUP BY stay_id, itemid, hour")
def mean_or_last(s: S, sf: str) -> DF:
    mean, last = A.mean_or_last(F.col("v"), F.col("value"), F.col("charttime"), F.col("value"))
    return readings(s, sf).groupBy("stay_id", "itemid", "hour").agg(F.round(mean, 4).alias("mean"), last.alias("last")).withColumn("hour", stamp("hour"))


@R.add("string_agg_ordered", f"WITH d AS (SELECT DISTINCT hadm_id, transfer_id, careunit, intime FROM transfers WHERE hadm_id IS NOT NULL AND careunit IS NOT NULL) SELECT hadm_id, string_agg(careunit, '; ' ORDER BY intime NULLS FIRST, careunit) AS units FROM d GROUP BY hadm_id")
def string_agg_ordered(s: S, sf: str) -> DF:
    d = table(s, sf, "transfers").where("hadm_id IS NOT NULL AND careunit IS NOT NULL").select("hadm_id", "transfer_id", "careunit", "intime").distinct()
    return d.groupBy("hadm_id").agg(A.ordered_text(F.col("careunit"), F.col("intime")).alias("units"))


@R.add("nested_rollup_text", "WITH x AS (SELECT DISTINCT hadm_id, coalesce(eventtype, 'other') AS e, careunit FROM transfers WHERE hadm_id IS NOT NULL), g AS (SELECT hadm_id, e || ': [' || string_agg(DISTINCT careunit, ', ' ORDER BY careunit) || ']' AS t FROM x WHERE careunit IS NOT NULL AND careunit <> 'none' GROUP BY hadm_id, e), f AS (SELECT hadm_id, string_agg(t, ', ' ORDER BY t) AS rollup FROM g GROUP BY hadm_id) SELECT h.hadm_id, f.rollup FROM (SELECT DISTINCT hadm_id FROM x) h LEFT JOIN f ON f.hadm_id = h.hadm_id")
def nested_rollup_text(s: S, sf: str) -> DF:
    t = table(s, sf, "transfers").where("hadm_id IS NOT NULL").select("hadm_id", F.coalesce("eventtype", F.lit("other")).alias("e"), "careunit")
    return A.rollup_text(t, ["hadm_id"], "e", "careunit")


@R.add("per_subject_stats", "WITH g AS (SELECT subject_id, count(*) AS n FROM (SELECT DISTINCT subject_id, hadm_id FROM admissions) GROUP BY subject_id) SELECT count(*) AS patients, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS least, max(n) AS most, count(*) FILTER (n = 1) AS single FROM g")
def per_subject_stats(s: S, sf: str) -> DF:
    g = table(s, sf, "admissions").select("subject_id", "hadm_id").distinct().groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("patients"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("single"))


@R.add("dedupe_keep_first", f"SELECT hadm_id::VARCHAR AS hadm_id, doc_id, {at('charttime')} AS charttime FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY charttime NULLS FIRST, doc_id) AS rn FROM documents) WHERE rn = 1 AND text IS NOT NULL")
def dedupe_keep_first(s: S, sf: str) -> DF:
    # texts are told apart by their SHA-256, so that no text is shuffled
    d = table(s, sf, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("code"), "hadm_id", "doc_id", "charttime")
    return A.keep_first(d, ["code"], ["charttime", "doc_id"]).select(F.col("hadm_id").cast("string").alias("hadm_id"), "doc_id", stamp("charttime").alias("charttime"))


@R.add("path_counts", "SELECT path, count(*) AS n FROM (SELECT unnest(['chart.' || itemid::VARCHAR, 'chart']) AS path FROM chartevents WHERE itemid IS NOT NULL) GROUP BY path")
def path_counts(s: S, sf: str) -> DF:
    p = table(s, sf, "chartevents").where("itemid IS NOT NULL").select(F.explode(F.array(F.concat(F.lit("chart."), F.col("itemid").cast("string")), F.lit("chart"))).alias("path"))
    return p.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@R.add("relative_frequency", "WITH g AS (SELECT itemid, count(*) AS n FROM chartevents GROUP BY itemid) SELECT itemid, n, round(n / (SELECT sum(n) FROM g), 8) AS share, round(n / (SELECT max(n) FROM g), 8) AS of_most FROM g")
def relative_frequency(s: S, sf: str) -> DF:
    f = A.relative_frequency(table(s, sf, "chartevents"), ["itemid"])
    return f.withColumns({c: F.round(c, 8) for c in ("share", "of_most")})


@R.add("power_mean", f"WITH {READINGS} SELECT stay_id, round(pow(avg(pow(v / 100, 3)), 1.0 / 3), 6) AS pm FROM readings WHERE v > 0 GROUP BY stay_id")
def power_mean(s: S, sf: str) -> DF:
    return readings(s, sf).where("v > 0").groupBy("stay_id").agg(F.round(A.power_mean(F.col("v") / 100), 6).alias("pm"))


@R.add("min_max_per_variable", f"SELECT itemid, min({num('valuenum')}) AS mn, max({num('valuenum')}) AS mx FROM chartevents WHERE {num('valuenum')} IS NOT NULL GROUP BY itemid")
def min_max_per_variable(s: S, sf: str) -> DF:
    c = table(s, sf, "chartevents").select("itemid", to_number(F.col("valuenum")).alias("v")).where("v IS NOT NULL")
    return c.groupBy("itemid").agg(F.min("v").alias("mn"), F.max("v").alias("mx"))


@R.add("percentiles_exact", f"SELECT itemid, round(quantile_cont({num('valuenum')}, 0.01), 6) AS p1, round(quantile_cont({num('valuenum')}, 0.02), 6) AS p2, round(quantile_cont({num('valuenum')}, 0.98), 6) AS p98, round(quantile_cont({num('valuenum')}, 0.99), 6) AS p99 FROM chartevents WHERE {num('valuenum')} IS NOT NULL GROUP BY itemid")
def percentiles_exact(s: S, sf: str) -> DF:
    c = table(s, sf, "chartevents").select("itemid", to_number(F.col("valuenum")).alias("v")).where("v IS NOT NULL")
    q = c.groupBy("itemid").agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.01, 0.02, 0.98, 0.99)])).alias("q"))
    return q.select("itemid", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p1", "p2", "p98", "p99"))])


@R.add("percentiles_approx")
def percentiles_approx(s: S, sf: str) -> DF:
    c = table(s, sf, "chartevents").select("itemid", to_number(F.col("valuenum")).alias("v")).where("v IS NOT NULL")
    q = c.groupBy("itemid").agg(F.percentile_approx("v", F.array(*[F.lit(x) for x in (0.01, 0.02, 0.98, 0.99)]), F.lit(10000)).alias("q"))
    return q.select("itemid", *[F.col("q")[i].alias(n) for i, n in enumerate(("p1", "p2", "p98", "p99"))])


@R.add("majority_value", "SELECT stay_id, itemid, value FROM (SELECT stay_id, itemid, value, row_number() OVER (PARTITION BY stay_id, itemid ORDER BY count(*) DESC, value) AS rn FROM chartevents WHERE value IS NOT NULL AND valuenum IS NULL AND stay_id IS NOT NULL GROUP BY stay_id, itemid, value) WHERE rn = 1")
def majority_value(s: S, sf: str) -> DF:
    c = table(s, sf, "chartevents").where("value IS NOT NULL AND valuenum IS NULL AND stay_id IS NOT NULL")
    n = c.groupBy("stay_id", "itemid", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("stay_id", "itemid").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


@R.add("collect_timepoints", "SELECT stay_id, count(*) AS n, string_agg(timepoint::VARCHAR, ',' ORDER BY timepoint) AS timepoints FROM (SELECT DISTINCT stay_id, timepoint FROM patient_yaml) GROUP BY stay_id")
def collect_timepoints(s: S, sf: str) -> DF:
    g = table(s, sf, "patient_yaml").select("stay_id", "timepoint").distinct().groupBy("stay_id").agg(F.array_sort(F.collect_list("timepoint")).alias("t"))
    return g.select("stay_id", F.size("t").cast("bigint").alias("n"), F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("timepoints"))


@R.add("label_prevalence", "SELECT subject_area, count(*) AS pos, round(ln(1 + (total - count(*)) / (count(*) + 1e-5)), 6) AS weight FROM subject_labels, (SELECT count(DISTINCT doc_id) AS total FROM subject_labels) GROUP BY subject_area, total")
def label_prevalence(s: S, sf: str) -> DF:
    lab = table(s, sf, "subject_labels")
    total = lab.agg(F.countDistinct("doc_id").alias("total"))
    g = lab.groupBy("subject_area").agg(F.count(F.lit(1)).alias("pos")).transform(attach, total)
    return g.select("subject_area", "pos", F.round(F.log1p((F.col("total") - F.col("pos")) / (F.col("pos") + 1e-5)), 6).alias("weight"))

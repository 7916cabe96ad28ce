"""Queries of problem 2 over the tables of stays, and of problems 8 to 10 over the whole document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.hashing import uniform_sql
from stayline.llm.contamination import leaked_spans, remove_spans
from stayline.llm.linked_splits import hash_to_min, linked_split, shared_key_edges
from stayline.llm.mixing import mix
from stayline.llm.subjects import subject_areas, train
from stayline.operators.common import attach, salted_join
from stayline.plans.registry import Registry, table

R = Registry()
WEIGHTS = {"train": 0.95, "validation": 0.025, "test": 0.025}
#: The area that documents of a source are mostly about, as far as its name says. Fixed values.
SOURCE_AREAS = {"handbook": "software", "consent": "legal", "billing": "finance"}


def patient_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of patients tied by a shared admission number, within or across the two tables."""
    a, s = table(spark, sf, "admissions"), table(spark, sf, "stay_to_ids_dict")
    links = a.select(F.col("subject_id").alias("patient"), F.col("hadm_id").alias("adm")).union(s.select("patient_id", "adm_id"))
    return hash_to_min(shared_key_edges(links, "patient", "adm"))


@R.add("p2_found", """
WITH RECURSIVE l AS (SELECT subject_id AS p, hadm_id AS a FROM admissions WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL UNION SELECT patient_id, adm_id FROM stay_to_ids_dict WHERE patient_id IS NOT NULL AND adm_id IS NOT NULL),
e AS (SELECT DISTINCT x.p, y.p AS q FROM l x JOIN l y ON x.a = y.a AND x.p <> y.p),
r(p, q) AS (SELECT p, q FROM e UNION SELECT r.p, e.q FROM r JOIN e ON e.p = r.q)
SELECT DISTINCT p AS patient_a, q AS patient_b FROM r WHERE p < q""")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    c = patient_components(spark, sf)
    a, b = c.select("component", F.col("node").alias("patient_a")), c.select("component", F.col("node").alias("patient_b"))
    return salted_join(a, b, ["component"]).where("patient_a < patient_b").select("patient_a", "patient_b")  # a hot component's pairs come from many tasks


_SCORE = lambda split, w: f"(-{w} / ln({uniform_sql(chr(39) + 'split|' + split + '|' + chr(39) + ' || component::VARCHAR')}))"
_T, _V, _E = (_SCORE(n, w) for n, w in WEIGHTS.items())


SPLITS_SQL = f"""
WITH RECURSIVE l AS (SELECT subject_id AS p, hadm_id AS a FROM admissions WHERE subject_id IS NOT NULL AND hadm_id IS NOT NULL UNION SELECT patient_id, adm_id FROM stay_to_ids_dict WHERE patient_id IS NOT NULL AND adm_id IS NOT NULL),
e AS (SELECT DISTINCT x.p, y.p AS q FROM l x JOIN l y ON x.a = y.a AND x.p <> y.p),
r(p, q) AS (SELECT p, q FROM e UNION SELECT r.p, e.q FROM r JOIN e ON e.p = r.q), m AS (SELECT p, min(q) AS q FROM r GROUP BY p),
t AS (SELECT 'admissions' AS tbl, hadm_id::VARCHAR AS row_key, subject_id AS patient FROM admissions UNION ALL SELECT 'stay_to_ids_dict', stay_id, patient_id FROM stay_to_ids_dict),
c AS (SELECT t.*, least(coalesce(m.q, patient), patient) AS component FROM t LEFT JOIN m ON m.p = t.patient)
SELECT *, CASE WHEN component IS NULL THEN NULL WHEN {_T} >= {_V} AND {_T} >= {_E} THEN 'train' WHEN {_V} >= {_E} THEN 'validation' ELSE 'test' END AS split FROM c"""


@R.add("p2_splits", SPLITS_SQL)
def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    c = patient_components(spark, sf)
    a = linked_split(table(spark, sf, "admissions"), "subject_id", c, WEIGHTS).select(F.lit("admissions").alias("tbl"), F.col("hadm_id").cast("string").alias("row_key"), F.col("subject_id").alias("patient"), "component", "split")
    s = linked_split(table(spark, sf, "stay_to_ids_dict"), "patient_id", c, WEIGHTS).select(F.lit("stay_to_ids_dict").alias("tbl"), F.col("stay_id").alias("row_key"), F.col("patient_id").alias("patient"), "component", "split")
    return a.unionByName(s)


@R.add("p2_split_shares", f"SELECT split, count(*) AS patients, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT DISTINCT patient, split FROM ({SPLITS_SQL}) WHERE patient IS NOT NULL) GROUP BY split")
def p2_split_shares(spark: SparkSession, sf: str) -> DataFrame:
    p = p2_splits(spark, sf).where("patient IS NOT NULL").select("patient", "split").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("patients"))
    total = p.agg(F.sum("patients").alias("total"))
    return p.transform(attach, total).select("split", "patients", F.round(F.col("patients") / F.col("total"), 6).alias("share"))


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


@R.add("p8_found")
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans(spark, sf).select("doc_id", "item_id").distinct()


@R.add("p8_spans")
def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    return spans(spark, sf)


@R.add("p8_cleaned")
def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return remove_spans(table(spark, sf, "documents").select("doc_id", "text"), spans(spark, sf), min_left=0.2)


@R.add("p9_mixture")
def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


@R.add("p9_report")
def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    r = mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]
    return r.withColumns({c: F.round(c, 6) for c in ("target_share", "feasible_share", "actual_share")})


def areas(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = train(docs, table(spark, sf, "subject_labels"), table(spark, sf, "subject_areas"), SOURCE_AREAS)
    return subject_areas(docs, model)


@R.add("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return areas(spark, sf).select("doc_id", "subject_area").distinct()


@R.add("p10_composition")
def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), F.length("text").alias("n"))
    got = areas(spark, sf).join(docs, "doc_id")
    return got.groupBy("source", "subject_area").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chars"), F.round(F.avg("share"), 4).alias("mean_share"))

"""Sources read back, further projections, pivots with info, section budgets, embeddings and samples by mode."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.hashing import uniform_sql
from stayline.functions.text import is_map, strip_unit, unit_of
from stayline.functions.time import hour_round, stamp
from stayline.operators import aggregates as A
from stayline.operators import budget as B
from stayline.operators import snapshot as N
from stayline.operators import tasks as K
from stayline.operators.common import shared_folder, written
from stayline.operators.joins import natural_left
from stayline.plans import catalogue_visits as V
from stayline.plans.catalogue_joins import _PIV, readings
from stayline.plans.registry import Registry, table
from stayline.plans.sql import READINGS, at, hour
from stayline.sources.files import read_stay, write_stays
from stayline.sources.typed import read_typed

R = Registry()
DF, S = DataFrame, SparkSession


@R.add("typed_scan_csv", f"SELECT subject_id, hadm_id, {at(hour('admittime'))} AS admittime, {at(hour('dischtime'))} AS dischtime, nullif(trim(discharge_location), '') AS discharge_location, hospital_expire_flag::INT AS hospital_expire_flag FROM admissions")
def typed_scan_csv(s: S, sf: str) -> DF:
    """Admissions written as text files with a header and read back typed, times on the hour."""
    path = f"{shared_folder(s)}/csv-{uuid.uuid4().hex}"
    a = table(s, sf, "admissions").select("subject_id", "hadm_id", "admittime", "dischtime", "discharge_location", "hospital_expire_flag")
    a.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in a.columns]).write.option("header", True).option("compression", "gzip").csv(path)
    t = read_typed(s, path, split=int(s.conf.get("spark.sql.shuffle.partitions")))
    return t.select(F.col("subject_id").cast("int").alias("subject_id"), F.col("hadm_id").cast("int").alias("hadm_id"), stamp(hour_round("admittime")).alias("admittime"), stamp(hour_round("dischtime")).alias("dischtime"), "discharge_location", F.col("hospital_expire_flag").cast("int").alias("hospital_expire_flag"))


@R.add("derived_table", "SELECT hadm_id, count(DISTINCT transfer_id) AS n, count(DISTINCT careunit) AS units FROM transfers WHERE hadm_id IS NOT NULL GROUP BY hadm_id")
def derived_table(s: S, sf: str) -> DF:
    """A table made of another, written to the shared folder and read again."""
    t, _ = written(table(s, sf, "transfers").where("hadm_id IS NOT NULL").select("hadm_id", "transfer_id", "careunit").distinct())
    return t.groupBy("hadm_id").agg(F.countDistinct("transfer_id").alias("n"), F.countDistinct("careunit").alias("units"))


@R.add("stays_written_and_read", "SELECT stay_id, max(itemid) AS itemid, count(*) AS n FROM chartevents WHERE stay_id = (SELECT max(stay_id) FROM chartevents) GROUP BY stay_id")
def stays_written_and_read(s: S, sf: str) -> DF:
    """Nested stays in hash buckets, and one of them read from its bucket alone."""
    c = table(s, sf, "chartevents").where("stay_id IS NOT NULL").select(F.col("stay_id").cast("string").alias("stay"), "stay_id", "itemid", "charttime")
    nested = c.groupBy("stay", "stay_id").agg(F.array_sort(F.collect_list(F.struct("charttime", "itemid"))).alias("events"))
    path = f"{shared_folder(s)}/stays-{uuid.uuid4().hex}"
    write_stays(nested, path, "stay", buckets=16)
    last = str(c.agg(F.max("stay_id")).first()[0])
    one = read_stay(s, path, "stay", last, buckets=16, schema=nested.schema)
    return one.select("stay_id", F.explode("events").alias("e")).groupBy("stay_id").agg(F.max("e.itemid").alias("itemid"), F.count(F.lit(1)).alias("n"))


@R.add("drop_map_values", r"SELECT itemid, count(*) AS n FROM chartevents WHERE value IS NOT NULL AND NOT regexp_matches(value, '^\s*\{.*\}\s*$') GROUP BY itemid")
def drop_map_values(s: S, sf: str) -> DF:
    return table(s, sf, "chartevents").where(F.col("value").isNotNull() & ~is_map(F.col("value"))).groupBy("itemid").agg(F.count(F.lit(1)).alias("n"))


@R.add("unit_override", r"SELECT subject_id, seq_num, strftime(chartdate, '%Y-%m-%d') AS day, regexp_replace(v, '(\d+)mm\b', '\1', 'g') AS v, CASE WHEN regexp_matches(v, '\d+mm\b') THEN 'mm' WHEN regexp_matches(v, '\d+cm\b') THEN 'cm' ELSE 'Inches' END AS unit FROM (SELECT *, result_value || CASE WHEN seq_num % 2 = 0 THEN 'mm' ELSE '' END AS v FROM omr WHERE result_name = 'Height (Inches)' AND result_value IS NOT NULL)")
def unit_override(s: S, sf: str) -> DF:
    v = F.concat("result_value", F.when(F.col("seq_num") % 2 == 0, "mm").otherwise(""))
    o = table(s, sf, "omr").where("result_name = 'Height (Inches)' AND result_value IS NOT NULL").withColumn("v", v)
    return o.select("subject_id", "seq_num", F.date_format("chartdate", "yyyy-MM-dd").alias("day"), strip_unit(F.col("v")).alias("v"), unit_of(F.col("v"), F.lit("Inches")).alias("unit"))


@R.add("natural_left_chain", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def natural_left_chain(s: S, sf: str) -> DF:
    """Four tables joined one after another on whatever columns they share."""
    o = table(s, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(s, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table(s, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    out = o
    for t in (c, n, table(s, sf, "region").select("r_regionkey", "r_name")):
        out = natural_left(out, t)
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


_PU = ", ".join(f"max(CASE WHEN itemid = {i} THEN m END) AS i{i}, max(CASE WHEN itemid = {i} THEN u END) AS i{i}_unit" for i in _PIV)


@R.add("pivot_with_units", f"WITH g AS (SELECT stay_id, {hour('charttime')} AS hour, itemid, round(avg(CASE WHEN isfinite(TRY_CAST(valuenum AS DOUBLE)) THEN TRY_CAST(valuenum AS DOUBLE) END), 4) AS m, min(valueuom) AS u FROM chartevents WHERE stay_id IS NOT NULL AND charttime IS NOT NULL AND itemid IS NOT NULL GROUP BY ALL) SELECT stay_id, {at('hour')} AS hour, {_PU} FROM g GROUP BY stay_id, hour HAVING count(m) > 0")
def pivot_with_units(s: S, sf: str) -> DF:
    from stayline.functions.numeric import to_number

    c = table(s, sf, "chartevents").where("stay_id IS NOT NULL AND charttime IS NOT NULL").select("stay_id", hour_round("charttime").alias("hour"), "itemid", to_number(F.col("valuenum")).alias("v"), "valueuom")
    return A.pivot_with_info(c, ["stay_id", "hour"], "itemid", _PIV, F.round(F.avg("v"), 4), {"unit": F.min("valueuom")}, "i").withColumn("hour", stamp("hour"))


@R.add("composite_key_filter", "SELECT c.stay_id, itemid, count(*) AS n FROM chartevents c WHERE EXISTS (SELECT 1 FROM icustays i WHERE i.subject_id = c.subject_id AND i.hadm_id = c.hadm_id AND i.stay_id = c.stay_id) GROUP BY c.stay_id, itemid")
def composite_key_filter(s: S, sf: str) -> DF:
    """Events of the stays that a key table holds under all three keys."""
    keys = ["subject_id", "hadm_id", "stay_id"]
    i = table(s, sf, "icustays").select(*keys).dropna().distinct()
    return table(s, sf, "chartevents").select(*keys, "itemid").join(i, keys, "left_semi").groupBy("stay_id", "itemid").agg(F.count(F.lit(1)).alias("n"))


_BUD = "concat_ws('|', 'sec', hadm_id::VARCHAR, s, doc_id::VARCHAR)"


@R.add("sections_to_budget", f"""WITH d AS (SELECT hadm_id, lower(trim(source)) AS s, doc_id, length(text)::BIGINT AS n FROM documents WHERE hadm_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL),
u AS (SELECT *, CASE WHEN s = 'radiology' THEN doc_id::DOUBLE ELSE {uniform_sql(_BUD)} END AS u, count(*) OVER (PARTITION BY hadm_id, s) AS c FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY hadm_id, s ORDER BY u, doc_id) AS k FROM u),
r AS (SELECT r FROM range(0, 11) t(r)), t AS (SELECT hadm_id, r, sum(CASE WHEN s = 'billing' OR k <= greatest(ceil(c * (10 - r) / 10.0), 1) THEN n ELSE 0 END) AS total FROM k, r GROUP BY hadm_id, r),
m AS (SELECT hadm_id, coalesce(min(r) FILTER (total <= 2000), 10) AS r FROM t GROUP BY hadm_id) SELECT hadm_id, doc_id, r / 10.0 AS drop_ratio FROM k JOIN m USING (hadm_id) WHERE s = 'billing' OR k <= greatest(ceil(c * (10 - r) / 10.0), 1)""")
def sections_to_budget(s: S, sf: str) -> DF:
    """Documents of an admission by source, thinned out to 2,000 characters; reports lose their last, bills nothing."""
    d = table(s, sf, "documents").where("hadm_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL").select("hadm_id", F.lower(F.trim("source")).alias("s"), "doc_id", F.length("text").cast("bigint").alias("n"))
    return B.sections_to_budget(d, ["hadm_id"], "s", "doc_id", "n", 2000, "sec", tail={"radiology": "doc_id"}, fixed=["billing"]).select("hadm_id", "doc_id", "drop_ratio")


@R.add("split_parts_random", f"WITH d AS (SELECT hadm_id, doc_id, floor((sum(length(text)) OVER (PARTITION BY hadm_id ORDER BY doc_id) - 1) / 400)::BIGINT AS part FROM documents WHERE hadm_id IS NOT NULL AND text <> ''), p AS (SELECT hadm_id, part, row_number() OVER (PARTITION BY hadm_id ORDER BY {uniform_sql("concat_ws('|', 'four', hadm_id::VARCHAR, part::VARCHAR)")}, part) AS r FROM (SELECT DISTINCT hadm_id, part FROM d)) SELECT hadm_id, doc_id, part FROM d JOIN p USING (hadm_id, part) WHERE r <= 4")
def split_parts_random(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").where("hadm_id IS NOT NULL AND text <> ''").select("hadm_id", "doc_id", F.length("text").alias("n"))
    return B.split_parts(d, ["hadm_id"], "doc_id", "n", 400, seed="four").select("hadm_id", "doc_id", "part")


@R.add("shorten_columns", "WITH d AS (SELECT hadm_id, doc_id, list_filter([lower(trim(source)), text], lambda x: x IS NOT NULL) AS p FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, p, list_sort(list_transform(p, lambda x: length(x))) AS ls FROM d), b AS (SELECT doc_id, p, CASE WHEN list_sum(ls) <= 180 THEN ls[-1] WHEN len(ls) = 1 THEN 180 WHEN ls[1] * 2 <= 180 THEN 180 - ls[1] ELSE 90 END AS b FROM l) SELECT doc_id, array_to_string(list_transform(p, lambda x: right(x, b)), ' | ') AS v FROM b")
def shorten_columns(s: S, sf: str) -> DF:
    """Two columns cut to 200 characters together, a tenth of them kept free."""
    d = table(s, sf, "documents").where("text IS NOT NULL").select("doc_id", F.filter(F.array(F.lower(F.trim("source")), F.col("text")), lambda x: x.isNotNull()).alias("p"))
    return d.select("doc_id", F.array_join(B.shorten(F.col("p"), F.lit(200), margin=0.1), " | ").alias("v"))


@R.add("prompt_labels", "SELECT doc_id, len(w) AS n, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS answer, -100 * len(q) AS masked FROM (SELECT doc_id, string_split(text, ' ') AS w, string_split(lower(trim(source)), ' ') AS q FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)")
def prompt_labels(s: S, sf: str) -> DF:
    """Labels of a prompt with its answer: the prompt masked, the answer's numbers (here the lengths of its words) kept."""
    ids = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x))
    d = table(s, sf, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", ids("text").alias("a"), ids(F.lower(F.trim("source"))).alias("q"))
    m = d.withColumn("m", B.label_mask(F.col("q"), F.col("a")))
    add = lambda c, keep: F.aggregate(F.filter(c, keep), F.lit(0).cast("bigint"), lambda x, y: x + y)
    return m.select("doc_id", F.size("a").cast("bigint").alias("n"), add(F.col("m"), lambda x: x >= 0).alias("answer"), add(F.col("m"), lambda x: x < 0).alias("masked"))


def _bag(texts: list[str]) -> np.ndarray:
    """A stand-in for a summarizer: ten states of sixteen hashed word counts, of which the last two end the text."""
    import zlib

    out = np.zeros((len(texts), 10, 16))
    for i, t in enumerate(texts):
        for w in t.split():
            h = zlib.crc32(w.encode())
            out[i, h % 10, (h >> 8) % 16] += 1
    return out


@R.add("embed_sections", "SELECT hadm_id, count(*)::INT AS docs, (8 * count(*))::INT AS states FROM documents WHERE hadm_id IS NOT NULL AND text IS NOT NULL GROUP BY hadm_id")
def embed_sections(s: S, sf: str) -> DF:
    """Documents of an admission embedded, their eight summary states cut out and put together in the order of the documents."""
    d = table(s, sf, "documents").where("hadm_id IS NOT NULL AND text IS NOT NULL").select("hadm_id", "doc_id", "text")
    e = B.embed(d, "text", _bag).withColumn("embedding", B.summary_slice(F.col("embedding"))).drop("text")
    g = B.group_embeddings(e, ["hadm_id"], ["doc_id"])
    return g.select("hadm_id", F.size("sections").alias("docs"), F.size(F.flatten("embedding")).alias("states"))


_TABLES = {"text": [("text", 0.33), ("summary", 0.33), ("both", 0.34)], "half": [("text", 0.5), ("summary", 0.5)], "most": [("summary", 0.66), ("both", 0.34)]}


def _choice_sql(name: str, options: list[tuple[str, float]]) -> str:
    acc, out = 0.0, "CASE"
    for n, p in options[:-1]:
        acc += p
        out += f" WHEN {uniform_sql(f"concat_ws('|', '{name}', doc_id::VARCHAR)")} < {acc} THEN '{n}'"
    return f"{out} ELSE '{options[-1][0]}' END AS {name}"


@R.add("augment_tables", f"SELECT doc_id, {', '.join(_choice_sql(n, o) for n, o in _TABLES.items())} FROM documents")
def augment_tables(s: S, sf: str) -> DF:
    """What of a sample is shown, by three tables of probabilities."""
    from stayline.operators.sampling import choose

    return table(s, sf, "documents").select("doc_id", *[choose(F.col("doc_id"), n, o).alias(n) for n, o in _TABLES.items()])


@R.add("visit_samples", f"WITH {V._WITH_ICU}, dn AS (SELECT visit, timepoint, count(*) AS n FROM de GROUP BY ALL), cn AS (SELECT visit, timepoint, count(*) AS n FROM fa GROUP BY ALL) SELECT pt.visit, pt.timepoint, coalesce(dn.n, 0) AS facts, coalesce(cn.n, 0) AS changes FROM pt LEFT JOIN dn ON dn.visit = pt.visit AND dn.timepoint = pt.timepoint LEFT JOIN cn ON cn.visit = pt.visit AND cn.timepoint = pt.timepoint")
def visit_samples(s: S, sf: str) -> DF:
    """Samples of all hours: what was known of the hospital stay, and the change log of the next hour; hours left are not told."""
    from stayline.operators.visits import build_admission

    h = build_admission(V.core(s, sf), {"transfers": table(s, sf, "transfers"), "omr": table(s, sf, "omr"), "labs": table(s, sf, "patient_yaml")})
    x = K.visit_samples(h, V.points(s, sf), V.change_facts(s, sf), held_out=True)
    return x.select("visit", "timepoint", F.size("desc").cast("bigint").alias("facts"), F.size("change").cast("bigint").alias("changes"))


@R.add("stay_at_hour", f"WITH {READINGS}, i AS (SELECT stay_id, min(intime) AS a, max(outtime) AS b FROM icustays GROUP BY stay_id), p AS (SELECT stay_id, unnest(generate_series({hour('a')}, {hour('b')}, INTERVAL 1 HOUR)) AS t FROM i WHERE {hour('b')} >= {hour('a')}) SELECT p.stay_id, {at('t')} AS t, count(*) AS n FROM p JOIN readings r ON r.stay_id = p.stay_id AND r.hour = p.t GROUP BY p.stay_id, t")
def stay_at_hour(s: S, sf: str) -> DF:
    """Readings of each hour of an ICU stay, within its bounds only."""
    i = table(s, sf, "icustays").groupBy("stay_id").agg(hour_round(F.min("intime")).alias("a"), hour_round(F.max("outtime")).alias("b")).where("b >= a")
    p = i.select("stay_id", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("t"))
    return N.exactly(readings(s, sf).select("stay_id", "itemid", "hour"), p, ["stay_id"], "hour").groupBy("stay_id", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("t", stamp("t"))

"""Ingest, projection and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.codes import in_words
from stayline.functions.icd import icd_chapter, icd_chapter_sql, ndc_key, ndc_product_key, tagged_parts
from stayline.functions.numeric import round_half_even, to_number
from stayline.functions.text import FINDING_HEADERS, SUMMARY_HEADERS, impression, last_match, replace_chain, strip_unit
from stayline.functions.time import hour_ceil, hour_floor, hour_round, hours_between, stamp
from stayline.operators.records import visible
from stayline.plans.registry import Registry, table
from stayline.plans.sql import at, hour, num

R = Registry()
DF, S = DataFrame, SparkSession


@R.add("typed_scan_parquet", "SELECT event_id, user_id::INT AS user_id, event_type, round_even(value, 2) AS value FROM events")
def typed_scan_parquet(s: S, sf: str) -> DF:
    e = table(s, sf, "events")
    return e.select("event_id", F.col("user_id").cast("int").alias("user_id"), "event_type", round_half_even(F.col("value")).alias("value"))


@R.add("hour_round_events", f"SELECT event_id, {at(hour('ts'))} AS hour, {at('''date_trunc('hour', ts)''')} AS hour_before, {at('''date_trunc('hour', ts + INTERVAL 3599999999 MICROSECOND)''')} AS hour_after FROM events")
def hour_round_events(s: S, sf: str) -> DF:
    return table(s, sf, "events").select("event_id", stamp(hour_round("ts")).alias("hour"), stamp(hour_floor("ts")).alias("hour_before"), stamp(hour_ceil("ts")).alias("hour_after"))


@R.add("hour_round_intervals", f"SELECT transfer_id, {at(hour('intime'))} AS intime, {at(hour('outtime'))} AS outtime, round(epoch(outtime - intime) / 3600.0, 4) AS hours FROM (SELECT DISTINCT * FROM transfers)")
def hour_round_intervals(s: S, sf: str) -> DF:
    t = table(s, sf, "transfers").distinct()
    return t.select("transfer_id", stamp(hour_round("intime")).alias("intime"), stamp(hour_round("outtime")).alias("outtime"), F.round(hours_between("intime", "outtime"), 4).alias("hours"))


@R.add("round2_measures", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 7.0, 2) AS price, round_even(l_tax, 2) AS tax FROM lineitem")
def round2_measures(s: S, sf: str) -> DF:
    return table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", round_half_even(F.col("l_extendedprice") / 7.0).alias("price"), round_half_even(F.col("l_tax")).alias("tax"))


@R.add("los_whole_days", "SELECT stay_id, CAST(trunc(round_even(epoch(outtime - intime) / 86400.0, 1)) AS INT) AS days FROM (SELECT DISTINCT * FROM icustays) WHERE outtime IS NOT NULL")
def los_whole_days(s: S, sf: str) -> DF:
    i = table(s, sf, "icustays").distinct().where("outtime IS NOT NULL")
    return i.select("stay_id", F.bround(hours_between("intime", "outtime") / 24, 1).cast("smallint").cast("int").alias("days"))


@R.add("floor_cast", f"SELECT stay_id, itemid, {at('charttime')} AS charttime, CAST(floor({num('valuenum')}) AS INT) AS v FROM chartevents WHERE {num('valuenum')} IS NOT NULL")
def floor_cast(s: S, sf: str) -> DF:
    c = table(s, sf, "chartevents").withColumn("n", to_number(F.col("valuenum"))).where("n IS NOT NULL")
    return c.select("stay_id", "itemid", stamp("charttime").alias("charttime"), F.floor("n").cast("int").alias("v"))


@R.add("null_fill_constants", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS event_type, coalesce(nullif(user_id, 8), -1) AS user_id FROM events")
def null_fill_constants(s: S, sf: str) -> DF:
    e = table(s, sf, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"), F.nullif("user_id", F.lit(8)).alias("user_id"))
    return e.fillna({"event_type": "none", "user_id": -1})


@R.add("lenient_time_parse", f"SELECT event_id, {at('''make_timestamp(epoch_us(date_trunc('second', ts)))''')} AS ts, {at('''date_trunc('day', ts)''')} AS day FROM events")
def lenient_time_parse(s: S, sf: str) -> DF:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    parsed = F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return table(s, sf, "events").select("event_id", stamp(parsed).alias("ts"), stamp(F.date_trunc("day", "ts")).alias("day"))


@R.add("compose_timestamp", "SELECT o_orderkey, strftime(make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), (o_orderkey % 24)::BIGINT, (o_orderkey % 60)::BIGINT, 0.0), '%Y-%m-%d %H:%M:%S') AS ts FROM orders")
def compose_timestamp(s: S, sf: str) -> DF:
    o = table(s, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("d"), ((F.col("o_orderkey") % 24) * 10000 + (F.col("o_orderkey") % 60) * 100).cast("double").alias("t"))
    text = F.concat(F.col("d").cast("string"), F.lpad(F.col("t").cast("bigint").cast("string"), 6, "0"))
    return o.select("o_orderkey", stamp(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))).alias("ts"))


@R.add("trim_codes", "SELECT DISTINCT trim(icd_code) AS icd_code, trim(icd_version) AS icd_version, length(icd_code) > length(trim(icd_code)) AS padded FROM diagnoses_icd")
def trim_codes(s: S, sf: str) -> DF:
    return table(s, sf, "diagnoses_icd").select(F.trim("icd_code").alias("icd_code"), F.trim("icd_version").alias("icd_version"), (F.length("icd_code") > F.length(F.trim("icd_code"))).alias("padded")).distinct()


@R.add("in_list_filter", f"SELECT itemid, count(*) AS n FROM chartevents WHERE itemid IN (240045, 240210, 240052) AND warning = 0 GROUP BY itemid")
def in_list_filter(s: S, sf: str) -> DF:
    return table(s, sf, "chartevents").where(F.col("itemid").isin(240045, 240210, 240052) & (F.col("warning") == 0)).groupBy("itemid").agg(F.count(F.lit(1)).alias("n"))


@R.add("not_null_filter", "SELECT hadm_id, transfer_id, careunit FROM transfers WHERE hadm_id IS NOT NULL AND careunit IS NOT NULL")
def not_null_filter(s: S, sf: str) -> DF:
    return table(s, sf, "transfers").dropna(subset=["hadm_id", "careunit"]).select("hadm_id", "transfer_id", "careunit")


@R.add("suffix_projection", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def suffix_projection(s: S, sf: str) -> DF:
    p = table(s, sf, "part")
    return p.select(*[c for c in p.columns if not c.endswith(("_size", "price"))])


@R.add("unit_strip_regex", r"SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR || ' by ' || l_linenumber::VARCHAR || CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'cm' END AS v FROM lineitem")
def unit_strip_regex(s: S, sf: str) -> DF:
    li = table(s, sf, "lineitem")
    raw = F.when(F.col("l_orderkey") % 2 == 0, F.format_string("%dmm by %dmm", F.col("l_quantity").cast("int"), "l_linenumber")).otherwise(F.format_string("%dmm by %dcm", F.col("l_quantity").cast("int"), "l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", strip_unit(raw).alias("v"))


_WAYS = {"AMBULANCE": "by ambulance", "WALK IN": "on foot", "HELICOPTER": "by air"}


@R.add("code_to_word_map", "SELECT DISTINCT stay_id, " + ", ".join(f"CASE arrival_transport {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _WAYS.items())} {e} END AS {n}" for e, n in (("", "known"), ("ELSE arrival_transport", "itself"))) + ", CASE gender WHEN 'F' THEN 'female' WHEN 'M' THEN 'male' END AS sex FROM ed_stays")
def code_to_word_map(s: S, sf: str) -> DF:
    way = F.col("arrival_transport")
    return table(s, sf, "ed_stays").select("stay_id", in_words(way, _WAYS).alias("known"), in_words(way, _WAYS, keep=True).alias("itself"), in_words(F.col("gender"), {"F": "female", "M": "male"}).alias("sex")).distinct()


@R.add("numeric_coercion", f"SELECT itemid, count({num('value')}) AS numeric, count(*) FILTER (value IS NOT NULL AND {num('value')} IS NULL) AS other, count(*) FILTER (value IS NULL) AS absent FROM chartevents GROUP BY itemid")
def numeric_coercion(s: S, sf: str) -> DF:
    n = to_number(F.col("value"))
    return table(s, sf, "chartevents").groupBy("itemid").agg(F.count(n).alias("numeric"), F.count_if(F.col("value").isNotNull() & n.isNull()).alias("other"), F.count_if(F.col("value").isNull()).alias("absent"))


@R.add("json_props_extract", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_props_extract(s: S, sf: str) -> DF:
    return table(s, sf, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@R.add("mask_after_time", "SELECT hadm_id, CASE WHEN dischtime <= TIMESTAMP '2150-01-01' THEN discharge_location END AS discharge_location, CASE WHEN dischtime <= TIMESTAMP '2150-01-01' THEN strftime(dischtime, '%Y-%m-%d') END AS discharged FROM admissions WHERE admittime <= TIMESTAMP '2150-01-01'")
def mask_after_time(s: S, sf: str) -> DF:
    """What is known at a moment: of stays begun by then, end facts only if the end has come (no leak of the future)."""
    now = F.lit("2150-01-01 00:00:00").cast("timestamp_ntz")
    a = visible(table(s, sf, "admissions").where(F.col("admittime") <= now), now, F.col("dischtime"), ["discharge_location", "dischtime"])
    return a.select("hadm_id", "discharge_location", F.date_format("dischtime", "yyyy-MM-dd").alias("discharged"))


@R.add("icd_category", f"SELECT hadm_id, seq_num, {icd_chapter_sql('trim(icd_code)')} AS category FROM diagnoses_icd WHERE trim(icd_version) = '9'")
def icd_category(s: S, sf: str) -> DF:
    return table(s, sf, "diagnoses_icd").where(F.trim("icd_version") == "9").select("hadm_id", "seq_num", icd_chapter(F.trim("icd_code")).alias("category"))


@R.add("icd_categories_per_stay", f"SELECT hadm_id, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), 'unknown') AS categories FROM (SELECT hadm_id, CASE WHEN trim(icd_version) = '9' THEN {icd_chapter_sql('trim(icd_code)')} END AS c FROM diagnoses_icd) GROUP BY hadm_id")
def icd_categories_per_stay(s: S, sf: str) -> DF:
    c = F.when(F.trim("icd_version") == "9", icd_chapter(F.trim("icd_code")))
    g = table(s, sf, "diagnoses_icd").withColumn("c", c).groupBy("hadm_id").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    return g.select("hadm_id", F.when(F.size("cs") == 0, F.lit("unknown")).otherwise(F.array_join("cs", ",")).alias("categories"))


@R.add("ndc_normalize", "SELECT p_partkey, substr(lpad((p_partkey * 71441)::VARCHAR, greatest(11, length((p_partkey * 71441)::VARCHAR))::INT, '0'), 1, 9) AS ndc, lpad((p_partkey % 100000)::VARCHAR, 5, '0') || lpad((p_partkey % 977)::VARCHAR, 4, '0') AS product FROM part")
def ndc_normalize(s: S, sf: str) -> DF:
    k = F.col("p_partkey")
    return table(s, sf, "part").select("p_partkey", ndc_key(k * 71441).alias("ndc"), ndc_product_key(F.concat_ws("-", (k % 100000).cast("string"), (k % 977).cast("string"))).alias("product"))


@R.add("epc_filter", "SELECT p_partkey, list_filter(list_transform(string_split(p_type || ' [EPC], ' || p_brand || ',' || p_name || '[EPC]', ','), lambda x: trim(x)), lambda x: contains(x, '[EPC]')) AS parts FROM part")
def epc_filter(s: S, sf: str) -> DF:
    text = F.concat("p_type", F.lit(" [EPC], "), "p_brand", F.lit(","), "p_name", F.lit("[EPC]"))
    return table(s, sf, "part").select("p_partkey", tagged_parts(text).alias("parts"))


@R.add("replace_chain", "SELECT subject_id, seq_num, strftime(chartdate, '%Y-%m-%d') AS day, replace(replace(replace(result_value, ' (estimate; see lab note)', ''), 'approx. ', ''), ', adjusted for body surface', '') AS v FROM omr WHERE result_name = 'eGFR'")
def replace_chain_q(s: S, sf: str) -> DF:
    o = table(s, sf, "omr").where("result_name = 'eGFR'")
    return o.select("subject_id", "seq_num", F.date_format("chartdate", "yyyy-MM-dd").alias("day"), replace_chain(F.col("result_value"), [(" (estimate; see lab note)", ""), ("approx. ", ""), (", adjusted for body surface", "")]).alias("v"))


_NAMES = lambda names: ", ".join(f"'{n}'" for n in names)
_LAST = lambda names: f"list_filter(s, lambda x: x.h IN ({_NAMES(names)}))"


@R.add("impression_section", rf"""
WITH d AS (SELECT doc_id, text, (string_split(regexp_replace(text, '\n([A-Z()/,-]+):\s', chr(1) || '\1' || chr(2), 'g'), chr(1)))[2:] AS parts FROM documents WHERE lower(trim(source)) = 'radiology'),
p AS (SELECT doc_id, text, list_transform(parts, lambda x: {{'h': lower(string_split(x, chr(2))[1]), 'b': regexp_replace(string_split(x, chr(2))[2], '^\s+|\s+$', '', 'g')}}) AS s FROM d)
SELECT doc_id, CASE WHEN len({_LAST(SUMMARY_HEADERS)}) > 0 THEN {_LAST(SUMMARY_HEADERS)}[-1].b WHEN len({_LAST(FINDING_HEADERS)}) > 0 THEN {_LAST(FINDING_HEADERS)}[-1].b ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS impression FROM p""")
def impression_section(s: S, sf: str) -> DF:
    d = table(s, sf, "documents").where("lower(trim(source)) = 'radiology'")
    return d.select("doc_id", impression(F.col("text")).alias("impression"))


@R.add("last_regex_match", r"SELECT doc_id, regexp_extract_all(text, 'hospital day (\d+)', 1)[-1] AS last_day FROM documents WHERE len(regexp_extract_all(text, 'hospital day (\d+)', 1)) > 0")
def last_regex_match(s: S, sf: str) -> DF:
    return table(s, sf, "documents").select("doc_id", last_match(F.col("text"), r"hospital day (\d+)").alias("last_day")).where("last_day IS NOT NULL")

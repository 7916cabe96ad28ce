"""Queries of whole samples: descriptions, change logs, their text, and sets of labels; files and the stream extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.functions.nested import nested_facts, nested_text
from stayline.functions.numeric import text_of
from stayline.functions.time import stamp
from stayline.operators import records as D
from stayline.plans.catalogue_joins import readings
from stayline.plans.registry import Registry, table
from stayline.plans.sql import READINGS, at
from stayline.plans.sql import text_of as text_sql
from stayline.streaming.hourly import hourly

R = Registry()
DF, S = DataFrame, SparkSession


def points(s: S, sf: str) -> DF:
    """Every hour of an ICU stay from its first to its last reading."""
    b = readings(s, sf).groupBy("stay_id").agg(F.min("hour").alias("a"), F.max("hour").alias("z"))
    return b.select("stay_id", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 HOUR"))).alias("t"))


_PTS = f"WITH {READINGS}, pts AS (SELECT stay_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS t FROM readings GROUP BY stay_id)"
_VALUE = f"CASE WHEN count(v) > 0 THEN {text_sql('round(avg(v), 6)')} ELSE arg_max(value, struct_pack(a := charttime, b := value)) FILTER (value IS NOT NULL) END"


@R.add("change_log_facts", _PTS + f" SELECT p.stay_id, {at('p.t')} AS t, 'ICU Stay.Chart Events.' || itemid::VARCHAR AS path, {_VALUE} AS value FROM pts p JOIN readings r ON r.stay_id = p.stay_id AND r.hour = p.t + INTERVAL 1 HOUR GROUP BY p.stay_id, p.t, itemid")
def change_log_facts(s: S, sf: str) -> DF:
    c = D.change_log(readings(s, sf), points(s, sf), ["stay_id"], "itemid")
    return c.select("stay_id", stamp("t").alias("t"), F.array_join("path", ".").alias("path"), "value")


@R.add("describe_snapshot", _PTS + f""", k AS (SELECT p.stay_id, p.t, itemid, r.hour, {_VALUE} AS s FROM pts p JOIN readings r ON r.stay_id = p.stay_id AND r.hour <= p.t AND r.hour > p.t - INTERVAL 24 HOUR GROUP BY p.stay_id, p.t, itemid, r.hour),
n AS (SELECT *, row_number() OVER (PARTITION BY stay_id, t, itemid ORDER BY hour DESC) AS rd, (epoch(t - hour) / 3600)::BIGINT AS ago FROM k WHERE s IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(s) OVER w = s AND (lag(rd) OVER w <= 5) = (rd <= 5) THEN 0 ELSE 1 END AS fresh FROM n WINDOW w AS (PARTITION BY stay_id, t, itemid ORDER BY hour)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY stay_id, t, itemid ORDER BY hour) AS run FROM f),
g AS (SELECT stay_id, t, itemid, run, any_value(s) AS s, any_value(rd <= 5) AS recent, max(ago) AS a, min(ago) AS b, string_agg(ago::VARCHAR, '/' ORDER BY hour) AS hs FROM r GROUP BY stay_id, t, itemid, run)
SELECT stay_id, {at('t')} AS t, 'ICU Stay.Chart Events.' || itemid::VARCHAR AS path, string_agg(CASE WHEN recent THEN hs WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '-' || b::VARCHAR END || ': ' || s, ', ' ORDER BY run) AS value FROM g GROUP BY stay_id, t, itemid""")
def describe_snapshot(s: S, sf: str) -> DF:
    d = D.describe(readings(s, sf), points(s, sf), ["stay_id"], "itemid")
    return d.select("stay_id", stamp("t").alias("t"), F.array_join("path", ".").alias("path"), "value")


@R.add("sample_records", _PTS + f" SELECT p.stay_id, {at('p.t')} AS t, count(DISTINCT CASE WHEN r.hour <= p.t AND value IS NOT NULL THEN itemid END) AS n_desc, count(DISTINCT CASE WHEN r.hour = p.t + INTERVAL 1 HOUR THEN itemid END) AS n_change FROM pts p JOIN readings r ON r.stay_id = p.stay_id AND r.hour > p.t - INTERVAL 24 HOUR AND r.hour <= p.t + INTERVAL 1 HOUR WHERE (r.hour <= p.t AND (value IS NOT NULL OR v IS NOT NULL)) OR r.hour = p.t + INTERVAL 1 HOUR GROUP BY p.stay_id, p.t")
def sample_records(s: S, sf: str) -> DF:
    r, p = readings(s, sf).where("value IS NOT NULL"), points(s, sf)
    x = D.samples(D.describe(r, p, ["stay_id"], "itemid"), D.change_log(readings(s, sf), p, ["stay_id"], "itemid"), ["stay_id"])
    return x.select("stay_id", stamp("t").alias("t"), F.size("desc").cast("bigint").alias("n_desc"), F.size("change").cast("bigint").alias("n_change"))


@R.add("yaml_roundtrip", "SELECT stay_id, timepoint, len(map_keys(lab_results)) AS n, true AS same FROM patient_yaml")
def yaml_roundtrip(s: S, sf: str) -> DF:
    """Labs as nested text and read back: the share of facts that return unchanged (all of them)."""
    y = table(s, sf, "patient_yaml").select("stay_id", "timepoint", F.transform(F.array_sort(F.map_entries("lab_results")), lambda e: F.struct(F.array(F.lit("Hospital Stay"), F.lit("Lab Results"), e["key"]).alias("path"), e["value"].alias("value"))).alias("facts"))
    t = y.withColumn("text", nested_text(F.col("facts")))
    back = t.withColumn("back", nested_facts(F.col("text")))
    return back.select("stay_id", "timepoint", F.size("back").cast("bigint").alias("n"), (F.col("back") == F.col("facts")).alias("same"))


@R.add("state_integrate", f"WITH {READINGS}, g AS (SELECT stay_id, hour, itemid FROM readings GROUP BY ALL) SELECT stay_id, count(*) AS n FROM (SELECT stay_id FROM readings UNION ALL SELECT stay_id FROM g) GROUP BY stay_id")
def state_integrate(s: S, sf: str) -> DF:
    r = readings(s, sf)
    every = r.select("stay_id", (F.col("hour") - F.expr("INTERVAL 1 HOUR")).alias("t")).distinct()
    c = D.change_log(r, every, ["stay_id"], "itemid")
    return D.integrate(r, c, ["stay_id"], "itemid").groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"))


_SET = "WITH a AS (SELECT DISTINCT subject_id FROM admissions), o AS (SELECT DISTINCT subject_id FROM omr)"


@R.add("subject_sets", _SET + " SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM o) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM o) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM o)")
def subject_sets(s: S, sf: str) -> DF:
    a, o = table(s, sf, "admissions").select("subject_id"), table(s, sf, "omr").select("subject_id")
    one = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return one(a.union(o).distinct(), "union").union(one(a.intersect(o), "intersect")).union(one(a.subtract(o), "except"))


@R.add("path_parse", "SELECT stay_id, split_part(stay_id, '_', 1)::INT AS patient, split_part(stay_id, '_', 2)::INT AS part, 'stay_' || stay_id || '.json_' || timepoint::VARCHAR AS path FROM patient_yaml")
def path_parse(s: S, sf: str) -> DF:
    p = table(s, sf, "patient_yaml").select(F.format_string("stay_%s.json_%d", "stay_id", "timepoint").alias("path"))
    x = lambda i: F.regexp_extract("path", r"^stay_(\d+)_(\d+)\.json_(\d+)$", i)
    return p.select(F.concat_ws("_", x(1), x(2)).alias("stay_id"), x(1).cast("int").alias("patient"), x(2).cast("int").alias("part"), "path")


@R.add("hourly_windows", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start_at, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(s: S, sf: str) -> DF:
    h = hourly(table(s, sf, "events"), "ts", ["event_type"], "value")
    return h.select("event_type", stamp("start_at").alias("start_at"), "n", F.round("total", 4).alias("total"))


@R.add("flagship_stay_text", f"WITH {READINGS}, h AS (SELECT stay_id, itemid, hour, avg(v) AS v FROM readings WHERE v IS NOT NULL GROUP BY ALL), m AS (SELECT stay_id, max(hour) AS now FROM h GROUP BY stay_id) SELECT h.stay_id, itemid, string_agg((epoch(now - hour) / 3600)::BIGINT::VARCHAR || ': ' || {text_sql('round(v, 6)')}, ', ' ORDER BY hour) AS last_day FROM h JOIN m ON m.stay_id = h.stay_id AND hour > now - INTERVAL 24 HOUR GROUP BY h.stay_id, itemid")
def flagship_stay_text(s: S, sf: str) -> DF:
    """Hour-rounded readings, hourly means, the trailing 24 hours at each stay's last hour, as text per item."""
    from stayline.operators.aggregates import ordered_text
    from stayline.operators.snapshot import until

    h = readings(s, sf).where("v IS NOT NULL").groupBy("stay_id", "itemid", "hour").agg(F.avg("v").alias("v"))
    now = h.groupBy("stay_id").agg(F.max("hour").alias("t"))
    w = until(h, now, ["stay_id"], "hour", trailing_hours=24)
    ago = F.expr("(unix_micros(CAST(t AS TIMESTAMP)) - unix_micros(CAST(hour AS TIMESTAMP))) DIV 3600000000").cast("string")
    return w.groupBy("stay_id", "itemid").agg(ordered_text(F.concat(ago, F.lit(": "), text_of(F.round("v", 6))), F.col("hour"), ", ").alias("last_day"))

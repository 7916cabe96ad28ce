import gzip
import json

from helpers import rows
from pyspark.sql import functions as F

from stayline.functions.nested import emit, nested_facts, nested_text, parse
from stayline.operators.simulate import simulate
from stayline.sources import files as S
from stayline.sources import typed as T
from stayline.streaming import hourly as H


def test_typed_csv(spark, tmp_path):
    p = tmp_path / "chart.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write('subject_id,hadm_id,charttime,chartdate,icd_code,temperature,sbp,los,warning,text\n1,2.0,2150-01-01 01:30:00.250,2150-01-01 00:00:00, 25000 ,98.765,120.9,2.96,1,"a, ""b""\nc"\n2,x,bad,,,nan,,,,\n')
    d = T.read_typed(spark, str(p), split=2, fill={"text": "none"})
    assert dict(d.dtypes)["hadm_id"] == "int" and dict(d.dtypes)["charttime"] == "timestamp_ntz" and dict(d.dtypes)["warning"] == "tinyint"
    r = {x.subject_id: x for x in d.withColumn("charttime", F.col("charttime").cast("string")).collect()}
    assert (r[1].hadm_id, r[1].charttime, r[1].icd_code, r[1].temperature, r[1].sbp, r[1].los, r[1].text) == (2, "2150-01-01 02:00:00", "25000", 98.76, 120, 3, 'a, "b"\nc')
    assert (r[2].hadm_id, r[2].charttime, r[2].temperature, r[2].text) == (None, None, None, "none")


def test_mapping_and_json(spark, tmp_path):
    (tmp_path / "m.tsv").write_bytes("PRODUCT\tName\n1\tcaf\xe9\n1\tcaf\xe9\n".encode("latin-1"))
    assert rows(T.read_mapping(spark, str(tmp_path / "m.tsv"), ["product", "name"])) == [("1", "café")]
    for n, x in (("a", {"s1": {"v": 1}}), ("b", {"s1": {"v": 2}, "s2": {"v": 3}})):
        (tmp_path / f"{n}.json").write_text(json.dumps(x))
    (tmp_path / "c.json").write_text("{broken")
    d = S.read_json_map(spark, str(tmp_path / "*.json"), "v int")
    assert rows(S.merge_maps(d, "key", "file"), "key", "v") == [("s1", 2), ("s2", 3)]


def test_sinks_listing_and_resume(spark, tmp_path):
    d = spark.createDataFrame([(f"s{i}", [i, i]) for i in range(20)], "stay_id string, v array<int>")
    S.write_stays(d, str(tmp_path / "stays"), "stay_id", 8)
    assert rows(S.read_stay(spark, str(tmp_path / "stays"), "stay_id", "s7", 8)) == [("s7", [7, 7])]
    S.write_documents(d, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 20
    S.write_csv(d.select("stay_id"), str(tmp_path / "csv"))
    assert S.listing(spark, str(tmp_path / "csv"), "*.gz").count() > 0
    calls = []
    work = lambda p: calls.append(1) or p.withColumn("done", F.lit(True))
    todo = d.select("stay_id")
    assert S.resume(spark, todo.limit(5), ["stay_id"], str(tmp_path / "out"), work, 2).count() == 5
    assert S.resume(spark, todo, ["stay_id"], str(tmp_path / "out"), work, 2).select("stay_id").distinct().count() == 20
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    (tmp_path / "c.yaml").write_text("'a':\n  'b': '1'\n")
    assert S.read_config(str(tmp_path / "c.yaml")) == {"a": {"b": "1"}}


def test_nested_text(spark):
    facts = [(["A", "b c"], "it's: 5"), (["A", "d"], None), (["E"], "")]
    assert parse(emit(facts)) == facts
    assert parse("'A':\n  junk without colon\n    'x': 'lost'\n  'b': '1'\nC: plain") == [(["A", "b"], "1"), (["C"], "plain")]
    assert parse(None) == [] and parse("%%%") == []
    d = spark.createDataFrame([([(["A", "b"], "1")],), (None,), ([],)], "f array<struct<path:array<string>,value:string>>")
    t = d.select("f", nested_text(F.col("f")).alias("t"))
    assert [r.t for r in t.collect()] == ["'A':\n  'b': '1'", None, ""]
    assert [len(r[0]) for r in t.select(nested_facts(F.col("t"))).collect()] == [1, 0, 0]


def test_simulation_ends(spark):
    st = spark.createDataFrame([("a", 0.0, 3), ("b", 0.0, 99), ("c", 0.0, 1)], "k string, v double, n int").withColumn("t", F.lit("2150-01-01 00:00:00").cast("timestamp_ntz"))
    step = lambda s: s.where("k <> 'c'").select("k", (F.col("v") + 1).alias("v"), (F.col("steps") + 1 >= F.col("n")).alias("over"))
    got = simulate(st, ["k"], step, max_steps=8, keep_every=3)
    assert rows(got, "k", "v", "steps", "ended_by") == [("a", 3.0, 3, "over"), ("b", 8.0, 8, "max_steps"), ("c", 0.0, 0, "over")]
    assert simulate(st.limit(0), ["k"], step, max_steps=3).count() == 0


def test_streams(spark, tmp_path):
    src, day = tmp_path / "in", "2150-01-01 "
    batches = [[(1, day + "00:10:00", "a", 1.0), (1, day + "00:20:00", "a", 2.0)], [(1, day + "09:00:00", "b", 3.0)], [(1, day + "00:30:00", "a", 9.0), (2, day + "09:10:00", "c", 1.0)], [(3, day + "20:00:00", "z", 0.0)]]
    schema = "u int, t timestamp, w string, v double"
    src.mkdir()
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    q = H.hourly(read(), "t", ["u"], "v").writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c1")).start()
    for n, x in enumerate(batches):
        spark.createDataFrame(x, "u int, t string, w string, v double").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(str(src / str(n)))
        q.processAllAvailable()
    q.stop()
    got = {(r.u, r.start_at.hour): (r.n, r.total) for r in spark.table("hours").collect()}
    assert got[(1, 0)] == (2, 3.0) and got[(1, 9)] == (1, 3.0)  # the late reading is left out
    q = H.runs(read(), "u", "t", "w").writeStream.outputMode("update").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.u, r.value, r.length) for r in spark.table("runs").collect()} >= {(1, "a", 2), (1, "b", 1), (3, "z", 1)}
    q = H.distinct_events(read(), "t", ["u"]).writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.u for r in spark.table("once").collect()} == {1, 2, 3}


def test_numbers_too_large_become_null(spark):
    d = spark.createDataFrame([("3e12", "99999999", "12.5")], "subject_id string, seq_num string, sbp string")
    assert rows(T.typed(d)) == [(None, None, 12)]

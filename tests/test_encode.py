from helpers import rows
from pyspark.sql import functions as F

from stayline.operators import encode as E


def periods(spark, hours, now, keep=None):
    d = spark.createDataFrame([("k", h) for h in hours], "k string, h long")
    return rows(E.period_text(E.islands(d, ["k"], "h"), ["k"], F.lit(now).cast("long"), keep))[0][1]


def test_periods(spark):
    assert periods(spark, [1, 2, 3, 5, 5], 6) == "5-3,1"
    assert periods(spark, [1, 3, 5, 7, 9], 10, 1) == "4x in past, current: 1"
    assert periods(spark, [1, 3, 5, 7], 10, 1) == "9,7,5,3"


def test_periods_decode_to_the_active_hours(spark):
    hours = [0, 1, 2, 7, 9, 10, 30]
    text = periods(spark, hours, 30)
    back = [30 - h for p in text.split(",") for h in range(int(p.split("-")[0]), int(p.split("-")[-1]) - 1, -1)]
    assert back == hours


def test_interleaved(spark):
    d = spark.createDataFrame([("k", "b", 3), ("k", "b", 4), ("k", "a", 1)], "k string, label string, h long")
    got = E.interleaved_text(E.islands(d, ["k", "label"], "h"), ["k"], "label", F.lit(5).cast("long"))
    assert rows(got) == [("k", "4-4: a, 2-1: b")]


def values(spark, vs):
    return spark.createDataFrame([("k", i, v) for i, v in enumerate(vs)], "k string, h long, v double")


def test_value_runs(spark):
    d = values(spark, [80.0, 80.0, 80.0, 90.0, 90.0, 90.0, 100.0]).withColumn("s", F.format_string("%.0f", "v"))
    got = E.run_text(E.value_runs(d, ["k"], "h", "s"), ["k"], F.lit(6).cast("long"))
    assert rows(got) == [("k", "6-5: 80, 4: 80, 3/2/1: 90, 0: 100")]
    got = E.run_text(E.value_runs(d, ["k"], "h", "s"), ["k"], F.lit(6).cast("long"), " days")
    assert rows(got)[0][1].startswith("6-5 days: 80")


def test_rest_and_majority(spark):
    d = values(spark, [80.0, 80.0, 80.0, 90.0, 90.0, 90.0, 100.0])
    assert rows(E.last_with_rest(d.withColumn("now", F.lit(6).cast("long")), ["k"], "h", "v", F.col("now"), 1)) == [("k", "past: 90-80, mean: 85, recent: 0: 100")]
    assert rows(E.last_with_rest(d.where("h > 4").withColumn("now", F.lit(6).cast("long")), ["k"], "h", "v", F.col("now"), 1)) == [("k", "1: 90, 0: 100")]
    w = spark.createDataFrame([("k", i, v) for i, v in enumerate(["b", "a", "a,a , b", "b", "x", None])], "k string, h long, w string")
    assert rows(E.majority_with_recent(w, ["k"], "h", "w", F.lit(4).cast("long"), 1)) == [("k", "past: majority: b, recent: 0: x")]


def test_ends_and_empty(spark):
    d = spark.createDataFrame([("k", 1, 1, 9), ("k", 4, 2, 9)], "k string, s int, id int, d int")
    assert rows(E.interval_ends(d, ["k"], "s", "id", F.col("d")), "s", "end_at") == [(1, 4), (4, 9)]
    assert E.islands(values(spark, []), ["k"], "h").count() == 0

from helpers import rows
from pyspark.sql import functions as F

from stayline.operators.references import count_by_period, late_references, orphan_references


def test_orphans_with_nulls_and_duplicates(spark):
    child = spark.createDataFrame([(1, "9", "a"), (2, "9", "b"), (2, "9", "b"), (3, None, "a"), (4, "9", None), (5, None, "c")], "id int, ver string, code string")
    parent = spark.createDataFrame([("9", "a"), ("9", "a"), (None, "c")], "ver string, code string")
    got = orphan_references(child, ["ver", "code"], parent, ["ver", "code"], required=["code"])
    assert rows(got, "id") == [(2,), (2,), (3,)]
    assert rows(orphan_references(child, ["ver", "code"], parent, ["ver", "code"]), "id") == [(2,), (2,)]


def test_empty_sides(spark):
    child = spark.createDataFrame([(1, 5)], "id int, k int")
    none = spark.createDataFrame([], "k int")
    assert rows(orphan_references(child, ["k"], none, ["k"]), "id") == [(1,)]
    assert rows(orphan_references(child.limit(0), ["k"], child, ["k"])) == []


def test_hot_key_and_parent_with_clashing_columns(spark):
    child = spark.range(400).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("k"), F.lit("x").alias("name"))
    parent = spark.range(1, 400).where("id <> 7").select(F.col("id").cast("int").alias("k"), F.lit("y").alias("name"))
    got = orphan_references(child, ["k"], parent, ["k"])
    assert got.count() == 135 and got.columns == ["id", "k", "name"]


def test_late(spark):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    child = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None), (5, 9)], "id int, k int").withColumn("at", t("2150-01-01 00:00:00"))
    p = spark.createDataFrame([(1, "2150-01-02 00:00:00"), (2, "2150-01-02 00:01:00"), (3, "2150-01-05 00:00:00"), (3, None)], "k int, b string").withColumn("b", F.col("b").cast("timestamp_ntz"))
    assert rows(late_references(child, "k", "at", p, "k", "b"), "id") == [(2,)]


def test_counts(spark):
    d = spark.createDataFrame([("t", "m1", "a"), ("t", "m1", "a"), ("t", None, "b")], "tbl string, month string, ref_key string")
    assert rows(count_by_period(d, ["tbl", "month"])) == [("t", "m1", 2, 1), ("t", None, 1, 1)]

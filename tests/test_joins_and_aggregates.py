from helpers import rows
from pyspark.sql import functions as F

from stayline.operators import aggregates as A
from stayline.operators import joins as J


def at(spark, data, schema, *cols):
    d = spark.createDataFrame(data, schema)
    return d.withColumns({c: F.timestamp_seconds(F.col(c).cast("double") * 3600).cast("timestamp_ntz") for c in cols})


def test_natural_join_matches_null_keys(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, "y")], "k int, j int, v string")
    b = spark.createDataFrame([(1, None, "p"), (2, 6, "q")], "k int, j int, w string")
    assert rows(J.natural_left(a, b)) == [(1, None, "x", "p"), (2, 5, "y", None)]


def test_tolerant_matches_are_not_one_to_one(spark):
    gt = at(spark, [("k", 10.0, 1.0), ("k", 12.0, 5.0)], "k string, t double, v double", "t")
    pred = at(spark, [("k", 11.0, 4.0)], "k string, t double, v double", "t")
    n = lambda a, b, how: J.tolerant(a, b, ["k"], "t", 3600, how).count()
    assert (n(gt, pred, "left_semi"), n(pred, gt, "left_anti"), n(gt, pred, "left_anti")) == (2, 0, 0)
    assert rows(J.nearest_value(pred, gt, ["k"], "t", "v", 3600), "v", "gt_value") == [(4.0, 5.0)]
    tie = at(spark, [("k", 11.0, 3.0)], "k string, t double, v double", "t")
    assert rows(J.nearest_value(tie, gt, ["k"], "t", "v", 3600), "gt_value") == [(1.0,)]
    assert rows(J.any_equal(tie, gt, ["k"], "t", "v", 3600), "equal") == [(False,)]


def test_containment_first_match_and_none(spark):
    p = at(spark, [("k", 5.0), ("k", 50.0), ("z", 1.0), (None, 1.0)], "k string, t double", "t")
    i = at(spark, [("k", 1, 0.0, 30.0), ("k", 2, 4.0, 6.0), ("k", 3, 9.0, 5.0)], "k string, id int, a double, b double", "a", "b")
    assert rows(J.within_intervals(p, i, ["k"], "t", "a", "b", "id"), "k", "id") == [("k", 1), ("k", None), ("z", None), (None, None)]
    edge = at(spark, [("k", 30.0)], "k string, t double", "t")
    assert rows(J.within_intervals(edge, i, ["k"], "t", "a", "b", "id"), "id") == [(1,)]
    assert rows(J.within_intervals(edge, i, ["k"], "t", "a", "b", "id", strict=True), "id") == [(None,)]


def test_aggregates(spark):
    d = spark.createDataFrame([("k", 1, None, "b"), ("k", 2, 4.0, None), ("k", 3, 8.0, "a"), ("z", 1, None, "w"), ("z", 2, None, "v"), ("n", 1, None, None)], "k string, o int, v double, s string")
    m, last = A.mean_or_last(F.col("v"), F.col("s"), F.col("o"))
    assert rows(d.groupBy("k").agg(m.alias("m"), last.alias("l"))) == [("k", 6.0, None), ("n", None, None), ("z", None, "v")]
    got = d.groupBy("k").agg(A.first_known(F.col("v"), F.col("o")).alias("f"), A.sum_or_zero(F.col("v")).alias("s"), A.ordered_text(F.col("s"), F.col("o")).alias("t"))
    assert rows(got) == [("k", 4.0, 12.0, "b; a"), ("n", None, 0.0, ""), ("z", None, 0.0, "w; v")]
    assert rows(A.keep_first(d, ["k"], ["o"]), "k", "o") == [("k", 1), ("n", 1), ("z", 1)]
    assert abs(d.where("v > 0").agg(A.power_mean(F.col("v"))).first()[0] - ((64 + 512) / 2) ** (1 / 3)) < 1e-9


def test_rollup_and_pivot(spark):
    d = spark.createDataFrame([("k", "o1", "y"), ("k", "o1", "x"), ("k", "o2", "none"), ("z", "o1", "none")], "k string, o string, i string")
    assert rows(A.rollup_text(d, ["k"], "o", "i")) == [("k", "o1: [x, y]"), ("z", None)]
    p = spark.createDataFrame([("k", "a", 1.0), ("k", None, 2.0), ("z", "b", None)], "k string, l string, v double")
    assert rows(A.pivot_points(p, ["k"], "l", ["a", "b"], F.sum("v"))) == [("k", 1.0, None)]

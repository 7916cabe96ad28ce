from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayline.operators.intervals import interval_gaps, merge_intervals


def frame(spark, data, key="k"):
    d = spark.createDataFrame(data, f"{key} string, id int, a int, b int, s string, n int")
    at = lambda c: F.timestamp_seconds(F.col(c).cast("long") * 3600).cast("timestamp_ntz")
    return d.withColumn("a", at("a")).withColumn("b", at("b"))


def brute(data):
    merged, gaps = set(), set()
    for k in {r[0] for r in data if r[0] is not None}:
        iv = sorted({(a, b, i) for kk, i, a, b in data if kk == k and a is not None and b is not None and b > a})
        cur = None
        for a, b, _ in iv:
            if cur and a <= cur[1]:
                cur[2] = cur[2] or a < cur[1]
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    merged.add((k, *cur))
                    gaps.add((k, cur[1], a))
                cur = [a, b, False]
        if cur:
            merged.add((k, *cur))
    return merged, gaps


def run(spark, data, shard_rows=1):
    d = frame(spark, [(*r, "x", 1) for r in data])
    p = merge_intervals(d, ["k"], "a", "b", "id", shard_rows)
    hour = lambda c: (F.unix_seconds(F.col(c).cast("timestamp")) / 3600).cast("int")
    m = {tuple(r) for r in p.select("k", hour("start_at"), hour("end_at"), "overlaps").collect()}
    g = {tuple(r) for r in interval_gaps(p, ["k"]).select("k", hour("start_at"), hour("end_at")).collect()}
    return m, g


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(1, 6), st.one_of(st.none(), st.integers(0, 120)), st.one_of(st.none(), st.integers(0, 120))), max_size=30))
def test_equals_brute_force_over_shards(spark, data):
    assert run(spark, data) == brute(data)


def test_touching_nested_reversed_duplicates(spark):
    data = [("k", 1, 0, 5), ("k", 1, 0, 5), ("k", 2, 5, 9), ("k", 3, 20, 30), ("k", 4, 22, 23), ("k", 5, 50, 40), ("k", 6, 60, 60), ("k", 7, 70, None), (None, 8, 0, 9)]
    m, g = run(spark, data)
    assert m == {("k", 0, 9, False), ("k", 20, 30, True)} and g == {("k", 9, 20)}


def test_one_long_interval_over_many_shards(spark):
    data = [("k", 0, 0, 1000)] + [("k", i, i * 10, i * 10 + 1) for i in range(1, 99)] + [("k", 200, 1001, 1002)]
    m, g = run(spark, data)
    assert m == {("k", 0, 1000, True), ("k", 1001, 1002, False)} and g == {("k", 1000, 1001)}


def test_empty_and_clashing_names(spark):
    assert rows(merge_intervals(frame(spark, []), ["k"], "a", "b", "id")) == []
    d = frame(spark, [("q", 1, 0, 5, "x", 3)])
    p = merge_intervals(d, ["s", "n"], "a", "b", "id")  # keys named as inner columns might be
    assert p.columns[:2] == ["s", "n"] and p.count() == 1

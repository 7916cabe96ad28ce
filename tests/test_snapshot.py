from helpers import rows
from pyspark.sql import functions as F

from stayline.operators import records as D
from stayline.operators import snapshot as N


def at(spark, data, schema, *cols):
    d = spark.createDataFrame(data, schema)
    return d.withColumns({c: F.timestamp_seconds(F.col(c).cast("double") * 3600).cast("timestamp_ntz") for c in cols})


def hour(c):
    return (F.unix_seconds(F.col(c).cast("timestamp")) / 3600).cast("int")


def test_hour_expand(spark):
    d = at(spark, [(1, 1.0, 3.0), (2, 5.0, None), (3, 5.0, 2.0), (4, None, None), (5, None, 9.5)], "i int, a double, b double", "a", "b")
    got = rows(N.hour_expand(d, "a", "b").select("i", hour("hour")))
    assert got == [(1, 1), (1, 2), (1, 3), (2, 5), (2, 6), (5, 10), (5, 8), (5, 9)]


def test_bounds_of_windows(spark):
    e = at(spark, [("k", float(h)) for h in range(-30, 60)], "k string, h double", "h")
    p = at(spark, [("k", 24.0), ("k", 30.0)], "k string, t double", "t")
    got = N.until(e, p, ["k"], "h", trailing_hours=24).groupBy(hour("t")).agg(F.min(hour("h")), F.max(hour("h")), F.count("h"))
    assert rows(got) == [(24, 1, 24, 24), (30, 7, 30, 24)]
    got = N.until(e, p, ["k"], "h", trailing_hours=24, closed=True).groupBy(hour("t")).agg(F.min(hour("h")))
    assert rows(got) == [(24, 0), (30, 6)]
    got = N.until(e, p, ["k"], "h", trailing_hours=24, by_date=True).groupBy(hour("t")).agg(F.min(hour("h")))
    assert rows(got) == [(24, 0), (30, 0)]
    assert N.until(e, p, ["k"], "h").count() == 55 + 61
    assert rows(N.exactly(e, p, ["k"], "h").select(hour("t"), hour("h"))) == [(24, 24), (30, 30)]


def test_snapshots_grow(spark):
    e = at(spark, [("k", float(h)) for h in (1, 5, 9)], "k string, h double", "h")
    p = at(spark, [("k", float(t)) for t in range(12)], "k string, t double", "t")
    n = [r[1] for r in sorted(rows(N.until(e, p, ["k"], "h").groupBy(hour("t").alias("t")).count()))]
    assert n == sorted(n)


def test_timepoints_and_clock(spark):
    d = at(spark, [("k", 0.0)], "k string, a double", "a")
    got = N.timepoints(d, "a", F.lit(2.7)).select("timepoint", "hour_idx", hour("t"))
    assert rows(got) == [(0, -1, -1), (1, 0, 0), (2, 1, 1), (3, 2, 2)]
    one = spark.range(1)
    assert one.select(N.hospital_hour(F.lit(6), F.lit(4)), N.hospital_hour(F.lit(6), F.lit(None).cast("int"))).first()[:] == (0, 6)


def test_change_log_is_the_next_hour_and_integrates(spark):
    r = at(spark, [("k", 1, 5.0, 5.2, 80.0, "80"), ("k", 1, 5.0, 5.3, 82.0, "82"), ("k", 2, 5.0, 5.1, None, "Soft"), ("k", 1, 9.0, 9.0, 1.0, "1")], "k string, itemid int, hour double, charttime double, v double, value string", "hour", "charttime")
    p = at(spark, [("k", 4.0), ("k", 5.0)], "k string, t double", "t")
    c = D.change_log(r, p, ["k"], "itemid")
    assert rows(c.select(hour("t"), F.array_join("path", "."), "value")) == [(4, "ICU Stay.Chart Events.1", "81"), (4, "ICU Stay.Chart Events.2", "Soft")]
    s = D.integrate(r, c, ["k"], "itemid")
    assert s.count() == 6 and rows(s.where("itemid = 2"), "value") == [("Soft",), ("Soft",)]
    d = D.describe(r, p, ["k"], "itemid")
    assert rows(d.select(hour("t"), F.element_at("path", -1), "value")) == [(5, "1", "0: 81"), (5, "2", "0: Soft")]
    assert D.describe(r.limit(0), p, ["k"], "itemid").count() == 0
    x = D.samples(d, c, ["k"])
    assert rows(x.select(hour("t"), F.size("desc"), F.size("change"))) == [(4, 0, 2), (5, 2, 0)]


def test_nothing_of_the_future(spark):
    d = at(spark, [("a", 5.0, "HOME"), ("b", 9.0, "HOME")], "k string, e double, place string", "e")
    now = F.timestamp_seconds(F.lit(7 * 3600)).cast("timestamp_ntz")
    assert rows(D.visible(d, now, F.col("e"), ["place"]), "k", "place") == [("a", "HOME"), ("b", None)]

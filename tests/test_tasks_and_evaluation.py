"""Weights, drawn cohorts and scores against plain Python."""

import datetime as dt
import math
from collections import Counter

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stayline.operators import budget as B
from stayline.operators import evaluation as Z
from stayline.operators import tasks as K
from stayline.operators.visits import ADM, ED, ICU, note_details

FACTS = "visit string, timepoint int, part string, sub string, section string, category string, label string, kind string, num double, text string"


def test_event_weights_equal_a_plain_loop(spark):
    ev = {("a", 1): ["x", "x2", f"{ADM}.Disposition.DIED", f"{ADM}.ICD categories.mental", f"{ADM}.ICD categories.circulatory"], ("a", 2): [f"{ADM}.Disposition.DISCHARGED", "x"], ("b", 1): [f"{ICU}.Stay 0.Disposition.DISCHARGED FROM ICU"], ("b", 2): ["x"] * 1, ("c", 1): []}
    n = Counter(p for ps in ev.values() for p in ps)
    total, most, eps = sum(n.values()), max(n.values()), 1e-10
    f = lambda p: n.get(p, most) / total + eps
    want = {}
    for k, ps in ev.items():
        one, pool = [], []
        for p in ps:
            if "Disposition" in p and p.startswith(ADM):
                u = f(f"{ADM}.Disposition.DISCHARGED")
                one.append(-math.log(u) * u / f(p))
            elif "Disposition" in p:
                pool.append(-math.log(f(p)))
            elif "ICD" in p:
                u = f(f"{ADM}.ICD categories.circulatory")
                pool.append(-math.log(u) * u / f(p) / 2)
            else:
                one.append(-math.log(f(p)))
        mean = lambda xs: (sum(x**3 for x in xs) / len(xs)) ** (1 / 3)
        if pool:
            one.append(mean(pool))
        want[k] = mean(one) if one else -math.log(most / total + eps)
    paths = spark.createDataFrame([(*k, p) for k, ps in ev.items() for p in ps], "visit string, timepoint int, path string")
    points = spark.createDataFrame(list(ev), "visit string, timepoint int")
    got = {(r.visit, r.timepoint): (r.raw, r.weight) for r in K.event_weights(paths, points).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k]) < 1e-9 for k in want) and abs(sum(w for _, w in got.values()) - 1) < 1e-9


def test_resample_and_multilabel_weights(spark):
    d = spark.range(400).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("label"), F.when(F.col("id") < 10, 0.0).otherwise(1.0).alias("w"))
    got = K.resample(d, ["id"], "label", 200, "s", weight="w").collect()
    n = Counter(r.label for r in got)
    assert n[0] == n[1] > 20 and min(r.id for r in got) >= 10
    again = K.resample(d, ["id"], None, 50, "s", weight="w", repeat=True)
    assert again.count() == 50 and rows(again, "draw", "id") == rows(K.resample(d.repartition(3), ["id"], None, 50, "s", weight="w", repeat=True), "draw", "id")
    c = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, []), (4, None), (5, ["zz"])], "id int, codes array<string>")
    w = {r.id: r.weight for r in K.multilabel_weights(c, ["id"], "codes", ["a", "b"]).collect()}
    a, b = math.log1p(3 / (2 + 1e-5)), math.log1p(4 / (1 + 1e-5))
    assert abs(w[1] - (a + b) / 2) < 1e-9 and abs(w[2] - a) < 1e-9 and w[3] == w[4] == w[5] == min(a, b)


def test_later_and_task_rows(spark):
    h = lambda n: dt.datetime(2150, 1, 1) + dt.timedelta(hours=n)
    p = spark.createDataFrame([("v", 1, h(0)), ("v", 2, h(60)), ("v", 3, h(99))], "visit string, timepoint int, t timestamp_ntz")
    e = spark.createDataFrame([("v", ADM, h(80), "DIED")], "visit string, part string, end_at timestamp_ntz, value string")
    f = K.later(p, e)
    got = {(r.timepoint, r.path[1]): r.value for r in f.collect()}
    assert got == {(1, "Future Disposition"): "DIED", (1, "24h Disposition"): "ALIVE", (1, "StayOver3days"): "STAYED", (2, "Future Disposition"): "DIED", (2, "24h Disposition"): "DIED", (2, "StayOver3days"): "DISCHARGED"}
    r = {x.timepoint: x for x in K.task_rows(p.withColumn("label", F.lit(1)), f.limit(0), f).collect()}
    assert [len(r[t].future) for t in (1, 2, 3)] == [3, 3, 0] and r[1].desc == []


def test_change_metrics(spark):
    row = lambda sec, label, kind, num=None, text=None, part=ADM: ("v", 1, part, "", sec, "", label, kind, num, text)
    gt = [row("Lab Results", "K", "value", 4.0, "4"), row("Lab Results", "Na", "value", 140.0, "140"), row("Lab Results", "U", "value", None, "NEG"), row("Prescriptions", "a", "active"), row("LOS", "", "los", 10.0, "10 hours"), row("Disposition", "", "end", None, "DIED"), row("ICD categories", "", "icd", None, "x")]
    pr = [row("Lab Results", "K", "value", 5.0, "5"), row("Lab Results", "Cl", "value", 99.0, "99"), row("Lab Results", "U", "value", None, "POS"), row("Prescriptions", "a", "active"), row("LOS", "", "los", 12.0, "12 hours"), row("Disposition", "", "end", None, "DISCHARGED"), row("ICD categories", "", "icd", None, "y")]
    b = spark.createDataFrame([("Lab Results", "K", 3.0, 5.0), ("Lab Results", "Na", 130.0, 145.0)], "section string, label string, low double, high double")
    m = {(r.level, r.domain, r.kind, r.metric): r.value for r in Z.change_metrics(spark.createDataFrame(gt, FACTS), spark.createDataFrame(pr, FACTS), b).collect()}
    lab = lambda kind, metric: m["domain", f"{ADM}.Lab Results", kind, metric]
    assert (lab("event", "tp"), lab("event", "fp"), lab("event", "fn")) == (2, 1, 1) and abs(lab("event", "f1") - 2 / 3) < 1e-9
    # K: 0.5 against 1; Na: 10/15 against the worse bound, which is the lower; Cl has no bounds
    assert lab("numerical", "skipped") == 1 and abs(lab("numerical", "mae") - (0.5 + 10 / 15) / 2) < 1e-9
    assert lab("categorical", "accuracy") == 0 and m["domain", f"{ADM}.LOS", "los", "mae"] == 2 and m["domain", f"{ADM}.Disposition", "disposition", "accuracy"] == 0
    assert m["domain", f"{ADM}.ICD categories", "event", "f1"] == 0 and m["domain", f"{ADM}.Prescriptions", "event", "f1"] == 1
    assert abs(m["macro", "all", "event", "f1"] - (2 / 3 + 0 + 1) / 3) < 1e-9 and abs(m["micro", "all", "event", "precision"] - 3 / 5) < 1e-9
    none = Z.change_metrics(spark.createDataFrame([], FACTS), spark.createDataFrame([], FACTS), b)
    assert none.where("level = 'domain'").count() == 0


def test_series_metrics(spark):
    h = lambda n: dt.datetime(2150, 1, 1) + dt.timedelta(minutes=n)
    s = "visit string, domain string, label string, t timestamp_ntz, num double, text string"
    gt = spark.createDataFrame([("v", "d", "hr", h(0), 80.0, "80"), ("v", "d", "hr", h(120), 90.0, "90"), ("v", "d", "pain", h(0), None, "Unable to assess")], s)
    pr = spark.createDataFrame([("v", "d", "hr", h(50), 82.0, "82"), ("v", "d", "hr", h(600), 99.0, "99"), ("v", "d", "pain", h(10), None, "uta")], s)
    b = spark.createDataFrame([("d", "hr", 60.0, 100.0)], "domain string, label string, low double, high double")
    r = Z.series_metrics(gt, pr, b).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and r.rmse == 2 and abs(r.rmse_scaled - 0.05) < 1e-9 and r.accuracy == 1
    assert Z.series_metrics(gt.limit(0), pr.limit(0), b).count() == 0


def test_reports_of_outcomes(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("a", 0, 0), ("b", 1, None), ("b", 0, 0), ("c", 1, 1), ("c", None, 1)], "g string, y int, p int")
    r = {x.g: x for x in Z.binary_report(d, "y", "p", ["g"]).collect()}
    assert (r["a"].n, r["a"].accuracy, r["a"].precision, r["a"].recall, r["a"].auc) == (4, 0.75, 1.0, 0.5, 0.75)
    assert r["b"].auc is None and r["b"].recall == 0 and r["c"].auc is None and r["c"].n == 1
    lab = lambda t, *a, **k: [x[0] for x in spark.createDataFrame([("DIED", False, 5.0), (None, True, 80.0), (None, True, 10.0), ("ADMITTED", False, 1.0), ("STAYED", False, 1.0)], "d string, r boolean, h double").select(Z.outcome_label(t, F.col("d"), F.col("r"), F.col("h"), **k)).collect()]
    assert lab("icu_los") == [None, 1, 0, 1, 1] and lab("icu_los", future=True) == [0, 0, 0, 0, 1] and lab("icu_mortality") == [1, 0, 0, 0, 0] and lab("ed_admission") == [0, 0, 0, 1, 0]
    with pytest.raises(ValueError):
        Z.outcome_label("nope", F.lit(1), F.lit(True), F.lit(1))
    m = {x.label: x for x in Z.multilabel_report(spark.createDataFrame([(["x"], ["x"]), (["y"], None)], "a array<string>, b array<string>"), "a", "b", ["x", "y", "z"]).collect()}
    assert m["x"].f1 == 1 and m["y"].recall == 0 and m["z"].auc is None


def test_notes_take_their_addenda_and_details(spark):
    n = spark.createDataFrame([("a", 1, "one"), ("b", 2, "two"), ("c", 3, None), ("d", 4, "four")], "note_id string, charttime int, text string")
    d = spark.createDataFrame([("a", "addendum_note_id", "d", 2), ("a", "addendum_note_id", "b", 1), ("a", "exam_name", "X", 1), ("zz", "exam_name", "Y", 1)], "note_id string, field_name string, field_value string, field_ordinal int")
    assert rows(note_details(n, d), "note_id", "text", "exam_name") == [("a", "one\ntwo\nfour", "X"), ("c", "", None)]


def test_budgets_of_sections(spark):
    e = spark.createDataFrame([("k", "s", f"e{i}", 10, i) for i in range(10)] + [("k", "t", f"e{i}", 10, i) for i in range(10)] + [("k", "f", "only", 30, 0)], "k string, s string, n string, len int, o int")
    got = B.sections_to_budget(e, ["k"], "s", "n", "len", 130, "x", tail={"t": "o"}, fixed=["f"])
    assert {r.drop_ratio for r in got.collect()} == {0.5} and sorted(r.n for r in got.where("s = 't'").collect()) == [f"e{i}" for i in range(5)] and got.where("s = 'f'").count() == 1
    least = B.sections_to_budget(e, ["k"], "s", "n", "len", 1, "x", fixed=["f"])
    assert Counter(r.s for r in least.collect()) == {"s": 1, "t": 1, "f": 1}


def test_embeddings_in_bytes(spark):
    import numpy as np

    d = spark.createDataFrame([("v", i, t) for i, t in enumerate(["a b", None, "c"])], "k string, i int, text string")
    e = B.embed(d, "text", lambda ts: np.array([[[300.0 * len(t), -300.0]] for t in ts]))
    assert rows(e, "i", "embedding") == [(0, [[127, -128]]), (1, [[0, -128]]), (2, [[127, -128]])]
    g = B.group_embeddings(e, ["k"], ["i"]).first()
    assert [x.i for x in g.sections] == [0, 1, 2] and g.embedding[1] == [[0, -128]]
    assert ED


def test_task_rows_describe_their_cohort_only(spark, monkeypatch):
    """The description of a task's rows is made for its points, not for all hours and cut down afterwards."""
    import os

    import pytest

    from stayline.operators import visits as V
    from stayline.plans import catalogue_visits

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    asked, describe = [], V.describe_visit
    monkeypatch.setattr(V, "describe_visit", lambda h, p, *a, **k: asked.append(p) or describe(h, p, *a, **k))
    n = catalogue_visits.task_rows_hospital_icd(spark, sf).count()
    assert n > 0 and [p.count() for p in asked] == [n]


def test_samples_find_their_changes_in_all_stretches(spark):
    """Changes stand beside the description of their point, wherever a stretch of time or of points ends."""
    import datetime as dt

    from stayline.operators import visits as V

    t0, n = dt.datetime(2150, 1, 1, 7), 230
    pts = spark.createDataFrame([("v", i + 1, t0 + dt.timedelta(hours=i)) for i in range(n)], "visit string, timepoint int, t timestamp_ntz")
    hist = V.build_ed(spark.createDataFrame([("v", 1, t0, t0, "M", "BLACK", "AMBULANCE")], "visit string, stay_id int, intime timestamp_ntz, outtime timestamp_ntz, gender string, race string, arrival_transport string"), {})
    new = spark.createDataFrame([("v", i, ["A", x], str(i)) for i in range(1, n + 1) if i % 3 for x in "yx"], "visit string, timepoint int, path array<string>, value string")
    got = V.known_at(hist, pts, 24, new).collect()
    assert sorted((r.timepoint, len(r.facts), tuple((".".join(f.path), f.value) for f in r.future)) for r in got) == [(i, 1, (("A.x", str(i)), ("A.y", str(i))) if i % 3 else ()) for i in range(1, n + 1)]

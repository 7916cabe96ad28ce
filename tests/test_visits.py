"""Histories, descriptions and change logs of one small visit whose tables are all there."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stayline.operators import changes as C
from stayline.operators import sections as G
from stayline.operators import visits as V


def h(n, minute=0):
    return dt.datetime(2150, 1, 1) + dt.timedelta(hours=n, minutes=minute)


@pytest.fixture(scope="module")
def visit(spark):
    f = spark.createDataFrame
    core = f([("v", 1, 10, h(0), h(30), "URGENT", "Private", "WHITE", "ENGLISH", 70, "F")], "visit string, subject_id int, hadm_id int, admittime timestamp_ntz, dischtime timestamp_ntz, admission_type string, insurance string, race string, language string, anchor_age int, gender string").withColumn("start", F.col("admittime"))
    t = {
        "transfers": f([(1, 10, 1, "Ward", h(0), h(5)), (1, 10, 2, "ICU A", h(6), h(9)), (1, 10, 3, None, h(9), h(10)), (2, 99, 4, "Other", h(0), h(5)), (1, 10, 5, "Ward", h(4), h(3))], "subject_id int, hadm_id int, transfer_id int, careunit string, intime timestamp_ntz, outtime timestamp_ntz"),
        "services": f([(1, 10, h(0), "MED"), (1, 10, h(8), "XX")], "subject_id int, hadm_id int, transfertime timestamp_ntz, curr_service string"),
        "omr": f([(1, h(-48), 1, "Weight (Lbs)", " 150 "), (1, h(0), 1, "Weight (Lbs)", "151"), (1, h(240), 1, "Weight (Lbs)", "9"), (1, h(0), 1, "Blood Pressure", "120/80")], "subject_id int, chartdate timestamp_ntz, seq_num int, result_name string, result_value string"),
        "labevents": f([(1, 10, 50, h(1, 20), "4.0", 4.0, "mEq/L", 3.5, 5.0), (1, 10, 50, h(1, 10), "4.4", 4.4, "mEq/L", 3.5, 5.0), (1, 10, 50, h(4), "4.2", 4.2, None, None, None), (1, 10, 51, h(2), "NEG", None, None, None, None)], "subject_id int, hadm_id int, itemid int, charttime timestamp_ntz, value string, valuenum double, valueuom string, ref_range_lower double, ref_range_upper double"),
        "d_labitems": f([(50, "Potassium"), (51, "Protein")], "itemid int, label string"),
        "microbiologyevents": f([(1, 10, h(3), "CULTURE", "E. COLI", "URINE", a, i) for a, i in (("drug b", "sensitive"), ("drug a", "sensitive"), ("drug c", "resistant"), ("none", "none"))], "subject_id int, hadm_id int, charttime timestamp_ntz, test_name string, org_name string, spec_type_desc string, ab_name string, interpretation string"),
        "prescriptions": f([(1, 10, "Aspirin", h(1), h(2)), (1, 10, "Aspirin", h(5), None)], "subject_id int, hadm_id int, drug string, starttime timestamp_ntz, stoptime timestamp_ntz"),
        "procedures_icd": f([(1, 10, h(0), " 1", "9"), (1, 10, h(0), "2", "9 ")], "subject_id int, hadm_id int, chartdate timestamp_ntz, icd_code string, icd_version string"),
        "d_icd_procedures": f([("1", "9", "Surgery"), ("2", "9", "Biopsy")], "icd_code string, icd_version string, long_title string"),
        "radiology": f([("n1", 1, 10, h(2), "CHEST\nFINDINGS: a\nIMPRESSION: all\nclear"), ("n2", 1, 10, h(3), "addendum")], "note_id string, subject_id int, hadm_id int, charttime timestamp_ntz, text string"),
        "radiology_detail": f([("n1", "exam_name", "X-ray", 2), ("n1", "exam_name", "Chest", 1), ("n1", "addendum_note_id", "n2", 1), ("zz", "exam_name", "gone", 1)], "note_id string, field_name string, field_value string, field_ordinal int"),
    }
    icu = f([("v", 1, 10, 7, h(6), h(9), "Stay 0")], "visit string, subject_id int, hadm_id int, stay_id int, intime timestamp_ntz, outtime timestamp_ntz, sub string")
    ti = {
        "inputevents": f([(7, 1, h(6), h(7))], "stay_id int, itemid int, starttime timestamp_ntz, endtime timestamp_ntz"),
        "outputevents": f([(7, 2, h(7), 40.0, "mL")], "stay_id int, itemid int, charttime timestamp_ntz, value double, valueuom string"),
        "procedureevents": f([(7, 3, h(6), h(6))], "stay_id int, itemid int, starttime timestamp_ntz, endtime timestamp_ntz"),
        "chartevents": f([(7, 4, h(6, 10), "80", "80", "bpm"), (7, 4, h(7), "90", "90", "bpm"), (7, 5, h(7), "3mm", None, None), (7, 5, h(8), "4mm", None, None)], "stay_id int, itemid int, charttime timestamp_ntz, value string, valuenum string, valueuom string"),
        "d_items": f([(1, "Saline", "Fluids"), (2, "Urine", "Output"), (3, "Line", "Access"), (4, "Heart Rate", "Routine Vital Signs"), (5, "Pupil", "Neuro/Logical")], "itemid int, label string, category string"),
    }
    ed = f([("v", 20, h(-6), h(-2), "M", "BLACK", "AMBULANCE")], "visit string, stay_id int, intime timestamp_ntz, outtime timestamp_ntz, gender string, race string, arrival_transport string")
    te = {
        "triage": f([(20, 98.6, None, "5", "Chest PAIN")], "stay_id int, temperature double, heartrate double, pain string, chiefcomplaint string").withColumns({c: F.lit(None).cast("double") for c in ("resprate", "o2sat", "sbp")}),
        "medrecon": f([(20, "b"), (20, "a"), (20, "b")], "stay_id int, name string"),
        "vitalsign": f([(20, h(-5), 98.0, "sinus"), (20, h(-4), 99.5, None)], "stay_id int, charttime timestamp_ntz, temperature double, rhythm string"),
        "pyxis": f([(20, h(-4), "Morphine", 1), (20, h(-4), "Morphine", 2)], "stay_id int, charttime timestamp_ntz, name string, gsn_rn int"),
        "diagnosis": f([(20, "ANGINA"), (20, "Unspecified")], "stay_id int, icd_title string"),
    }
    hist = V.build_admission(core, t).unionByName(V.build_icu(icu, ti)).unionByName(V.build_ed(ed, te))
    pts = V.visit_points(f([("v", h(-6), h(-2), h(0), h(30))], "visit string, ed_in timestamp_ntz, ed_out timestamp_ntz, adm_in timestamp_ntz, adm_out timestamp_ntz"))
    return {"core": core, "hist": hist, "pts": pts, "icu": icu}


def described(visit, hour, **kw):
    d = V.describe_visit(visit["hist"], visit["pts"].where(F.col("t") == F.lit(h(hour))).where("phase = 'hospital'"), **kw)
    return {".".join(r.path): r.value for r in d.collect()}


def test_clock_of_a_visit(visit):
    p = {r.hour_idx: (r.timepoint, r.phase, r.t) for r in visit["pts"].collect()}
    assert p[-1] == (0, "ed", h(-7)) and p[4] == (5, "ed", h(-2)) and p[5][1] == "admitted" and p[6] == (7, "hospital", h(0)) and max(p) == 36


def test_description_of_all_parts(visit):
    d = described(visit, 8, trailing=None)
    adm, icu, ed = "Hospital Stay.", "ICU Stay.Stay 0.", "Emergency Department Stay."
    assert d[adm + "General"] == "urgent patient, 70-year old female, insurance: Private, white, language: english"
    assert d[adm + "Patient Location"] == "8-3: Ward, 2-0: ICU A" and d[adm + "Care Taker"] == "8-0: Medical, 0-0: XX"
    assert d[adm + "Outpatient Measurements.Weight (Lbs)"] == "2 days: 150, 0 days: 151" and d[adm + "Outpatient Measurements.Blood Pressure"] == "0 days: 120/80"
    assert d[adm + "Lab Results.Potassium (mEq/L, normal range: 3.5-5)"] == "7/4: 4.2" and d[adm + "Lab Results.Protein"] == "6: NEG"
    assert d[adm + "Microbiology Growth Results.CULTURE - urine"] == "5: E. COLI antibiotics: resistant: [drug c], sensitive: [drug a, drug b]"
    assert d[adm + "Prescriptions.Aspirin"] == "7-6,3-2" and d[adm + "Procedures.0 days"] == "Biopsy; Surgery"
    assert d[adm + "Radiology Notes.6"] == "Chest; X-ray: CHEST FINDINGS: a IMPRESSION: all clear addendum"
    assert d[icu + "Medication.Saline"] == "2-1" and d[icu + "Output.Urine(mL)"] == "1: 40" and d[icu + "Procedures.Line"] == "2"
    assert d[icu + "Chart Events.RoutineVitalSigns.Heart Rate(bpm)"] == "2: 80, 1: 90" and d[icu + "Chart Events.Neuro_Logical.Pupil(mm)"] == "1: 3, 0: 4"
    assert d[ed + "General"] == "ambulance patient, male, black" and d[ed + "Chief Complaint"] == "chest pain" and d[ed + "Admission Vitals.pain"] == "5/10" and d[ed + "Admission Vitals.temperature"] == "98F"
    assert d[ed + "Medicine Reconciliation"] == "a, b" and d[ed + "Diagnosis"] == "angina" and d[ed + "Medication.Morphine"] == "12"
    assert d[ed + "Vital Measurements.temperature (F)"] == "13: 98, 12: 99.5" and d[ed + "Vital Measurements.rhythm"] == "13: sinus"


def test_windows_and_levels(visit):
    d = described(visit, 8, trailing=2)
    assert "Hospital Stay.Lab Results.Protein" not in d and d["Hospital Stay.Patient Location"] == "2-0: ICU A" and d["Hospital Stay.Outpatient Measurements.Weight (Lbs)"] == "0 days: 151"
    d = described(visit, 8, trailing=None, level=3)
    assert d["Hospital Stay.Radiology Notes.6"].startswith("Chest; X-ray: all clear") and d["ICU Stay.Stay 0.Chart Events.RoutineVitalSigns.Heart Rate(bpm)"] == "2: 80, 1: 90"
    assert not any("ICU" in k for k in described(visit, 5, trailing=None))


def test_changes_end_cases_and_the_way_back(spark, visit):
    p = C.with_next(visit["pts"])
    ends = C.end_cases(spark.createDataFrame([("v", "OTHER", h(-2))], "visit string, disposition string, outtime timestamp_ntz"), spark.createDataFrame([("v", "HOME", h(30))], "visit string, discharge_location string, dischtime timestamp_ntz"))
    codes = spark.createDataFrame([("v", V.ADM, "circulatory;mental")], "visit string, part string, value string")
    f = C.change_facts(visit["hist"], p, visit["icu"].select("visit", "sub", "intime", "outtime"), ends, codes).cache()
    at = {}
    for r in f.collect():
        at.setdefault(r.timepoint, {})[".".join(r.path)] = r.value
    assert at[5] == {"Emergency Department Stay.Disposition": "ADMITTED"}
    assert at[37] == {"Hospital Stay.Disposition": "DISCHARGED", "Hospital Stay.ICD categories": "circulatory;mental"}
    six = at[12]  # the hour before hospital hour 6
    assert six["Hospital Stay.Disposition"] == "ADMITTED TO ICU" and six["Hospital Stay.Patient Location"] == "ICU A" and six["ICU Stay.Stay 0.Medication"] == "Saline" and six["ICU Stay.Stay 0.Chart Events.RoutineVitalSigns.Heart Rate"] == "80"
    assert at[15]["ICU Stay.Stay 0.Disposition"] == "DISCHARGED FROM ICU" and at[9]["Hospital Stay.Microbiology Growth Results.CULTURE - urine"] == "E. COLI"
    flat = {r.path for r in C.flat_paths(f).collect()}
    assert {"Hospital Stay.ICD categories.mental", "Hospital Stay.Disposition.DISCHARGED", "ICU Stay.Stay 0.Disposition.DISCHARGED FROM ICU"} <= flat
    typed = C.read_changes(C.change_text(f))
    assert typed.count() == f.count() + 2  # a row for each of two categories and of two procedures
    state, endings = C.fold(visit["hist"].limit(0), typed, p)
    again = C.change_facts(state, p, visit["icu"].select("visit", "sub", "intime", "outtime"), ends, codes)
    assert rows(again, "timepoint", "path", "value") == rows(f, "timepoint", "path", "value")
    assert rows(C.over(endings), "visit", "ended_by") == [("v", "DISCHARGED")]


def test_faults_in_a_text_lose_only_themselves(spark):
    text = "'Hospital Stay':\n  'Lab Results':\n    'K': '4.5'\n    'broken line\n    'Na': 'high'\n  'Nonsense':\n    'x': '1'\n  'LOS': '12 hours'\n'ICU Stay':\n  'Room 1':\n    'Output':\n      'Urine': '3'\n  'Stay 1':\n    'Medication': 'a; b; '\n    'Output': '7'\n'Other': 'x'"
    d = spark.createDataFrame([("v", 1, text), ("w", 1, "???"), ("u", 1, None)], "visit string, timepoint int, text string")
    got = {(r.visit, r.part, r.sub, r.section, r.label, r.num, r.text) for r in C.read_changes(d).collect()}
    assert got == {("v", V.ADM, "", "Lab Results", "K", 4.5, "4.5"), ("v", V.ADM, "", "Lab Results", "Na", None, "high"), ("v", V.ADM, "", "LOS", "", 12.0, "12 hours"), ("v", V.ICU, "Stay 1", "Medication", "a", None, None), ("v", V.ICU, "Stay 1", "Medication", "b", None, None)}


def test_missing_tables_give_an_empty_history(spark, visit):
    core = visit["core"].drop("admission_type")
    assert V.build_admission(core, {}).count() == 0
    assert V.describe_visit(V.build_admission(core, {}), visit["pts"]).count() == 0


def test_hours_left(spark, visit):
    ends = spark.createDataFrame([("v", V.ADM, "", h(0), h(30))], "visit string, part string, sub string, begin_at timestamp_ntz, end_at timestamp_ntz")
    exact = {r.timepoint: r.value for r in V.los_facts(visit["pts"], ends, "exact").collect()}
    noisy = {r.timepoint: int(r.value.split()[0]) for r in V.los_facts(visit["pts"], ends, "noise").collect()}
    assert exact[7] == "30 hours" and exact[37] == "0 hours" and min(exact) == 7 and 5 < len(noisy) < 28
    assert all(0.8 * int(exact[k].split()[0]) - 1 <= v <= 1.2 * int(exact[k].split()[0]) + 1 for k, v in noisy.items())


def test_sections(spark):
    p = lambda *x: list(x)
    desc = [("v", t, p(V.ADM, "General"), "g") for t in (1, 2)] + [("v", t, p(V.ADM, "Lab Results", "K"), "4") for t in (1, 2)] + [("v", 1, p(V.ICU, "Stay 0", "Chart Events", "Alarms", "x"), "1"), ("v", 1, p("Nowhere"), "1"), ("w", 3, p(V.ED, "General"), "e")]
    chg = [("v", 1, p(V.ADM, "Lab Results", "K"), "5"), ("v", 2, p(V.ICU, "Stay 0", "Chart Events", "Alarms", "x"), "1")]
    d, c = (spark.createDataFrame(x, "visit string, timepoint int, path array<string>, value string") for x in (desc, chg))
    dim = G.dimension(spark)
    assert dim.select("section_name").distinct().count() == 31
    i = G.section_index(d, c, dim).cache()
    assert rows(i, "section_name", "sub", "timepoint", "state") == [("ED_Stay", "", 3, "empty"), ("HS_General__HA_PatientLocation__HA_CareTaker", "", 1, "static"), ("HS_LabResults", "", 1, "changed"), ("HS_LabResults", "", 2, "empty"), ("ICU_CE_Alarms", "Stay 0", 1, "empty")]
    s = {(r.section_name, r.timepoint): r for r in G.section_content(d, c, i, dim).collect()}
    assert [x.value for x in s["HS_LabResults", 1].change] == ["5"] and s["HS_LabResults", 2].change == [] and s["HS_General__HA_PatientLocation__HA_CareTaker", 1].change is None
    assert {r.timepoint: len(r.sections) for r in G.sections_of_samples(i).where("visit = 'v'").collect()} == {1: 3, 2: 1}


def test_draws_by_section(spark):
    """Sections are drawn by the logarithm of their size, their samples evenly, and a tenth as many unchanged ones on top."""
    import math

    data = [("big", f"b{i}", "", 1, "changed") for i in range(400)] + [("small", f"s{i}", "", 1, "changed") for i in range(20)] + [("big", f"e{i}", "", 1, "empty") for i in range(100)]
    i = spark.createDataFrame(data, "section_name string, visit string, sub string, timepoint int, state string")
    d = G.draw_sections(i, 2000, "t").cache()
    n = dict(rows(d.where("draw IS NOT NULL").groupBy("section_name").count()))
    share = math.log(400) / (math.log(400) + math.log(20))
    assert sum(n.values()) == 2000 and abs(n["big"] / 2000 - share) < 0.04
    extra = d.where("draw IS NULL")
    assert extra.count() == min(100, int(0.1 * n["big"])) == extra.select("visit").distinct().count() and extra.where("section_name = 'small'").count() == 0
    assert rows(G.draw_sections(i.repartition(5), 2000, "t")) == rows(d)


def shuffled(spark, df):
    """Bytes that running a frame writes to shuffles, and its rows."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    none = sc._gateway.new_array(sc._gateway.jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before, n = total(), df.count()
    return total() - before, n


def test_descriptions_of_all_hours_dont_carry_readings_by_hour(spark):
    """A reading is shuffled a few times, not once for each hour from which it is seen."""
    n = 4000
    hist = spark.range(n).selectExpr("'v' AS visit", "'Hospital Stay' AS part", "'' AS sub", "'Lab Results' AS section", "'' AS category", "'Sodium' AS label", "'value' AS kind", "timestamp_ntz'2150-01-01' + make_dt_interval(0, CAST(id AS INT)) AS hour", "CAST(id * 7 % 1000 AS DOUBLE) AS num", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS unit", "CAST(NULL AS DOUBLE) AS low", "CAST(NULL AS DOUBLE) AS high")
    pts = V.visit_points(spark.createDataFrame([("v", h(0), h(n - 1))], "visit string, adm_in timestamp_ntz, adm_out timestamp_ntz").withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("ed_in", "ed_out")}))
    size, facts = shuffled(spark, V.describe_visit(hist, pts).withColumn("n", F.length("value")).where("n > 0"))
    assert facts == n
    assert size < 150 * n


def test_texts_over_the_edges_of_stretches(spark):
    """All hours of a long visit as runs and periods, against what is worked out hour by hour here."""
    at = [i for i in range(300) if i % 7 not in (3, 4)]
    word = lambda i: str(i // 3 % 2)
    like = "visit string, part string, sub string, section string, category string, label string, kind string, hour timestamp_ntz, num double, text string, unit string, low double, high double"
    read = [("v", V.ADM, "", "Lab Results", "", "X", "value", h(i), float(word(i)), None, "u" if i % 50 == 0 else None, None, None) for i in at]
    where = [("v", V.ADM, "", "Patient Location", "", "Ward", "active", h(i), None, None, None, None, None) for i in at]
    drug = [("v", V.ADM, "", "Prescriptions", "", "D", "active", h(i), None, None, None, None, None) for i in at]
    pts = V.visit_points(spark.createDataFrame([("v", h(0), h(299))], "visit string, adm_in timestamp_ntz, adm_out timestamp_ntz").withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("ed_in", "ed_out")}))
    got = {(r.timepoint, r.path[1], r.path[-1]): r.value for r in V.describe_visit(spark.createDataFrame(read + where + drug, like), pts).collect()}

    def periods(hours, now, single):
        runs = []
        for i in hours:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        return [str(now - a) if a == b and single else f"{now - a}-{now - b}" for a, b in runs]

    want = {}
    for now in range(300):
        seen = [i for i in at if now - 24 < i <= now]
        tokens = []
        for k, i in enumerate(seen):
            recent = k >= len(seen) - 5
            if tokens and tokens[-1][0] == (word(i), recent):
                tokens[-1][1].append(now - i)
            else:
                tokens.append([(word(i), recent), [now - i]])
        text = ", ".join(f"{'/'.join(map(str, a)) if r else a[0] if len(a) == 1 else f'{a[0]}-{a[-1]}'}: {w}" for (w, r), a in tokens)
        label = "X (u)" if any(i % 50 == 0 for i in seen) else "X"
        want[now + 1, "Lab Results", label] = text
        want[now + 1, "Prescriptions", "D"] = ",".join(periods(seen, now, True))
        closed = [i for i in at if now - 24 <= i <= now]
        want[now + 1, "Patient Location", "Patient Location"] = ", ".join(f"{p}: Ward" for p in periods(closed, now, False))
    assert got == want

import math
import random

from helpers import rows
from pyspark.sql import functions as F

from stayline.operators.spikes import Limits, SpikeRules, flag_readings
from stayline.plans.data_problems import omr_flags

LIMITS = {("w",): Limits(50, 700, 0.1), ("h",): Limits(36, 90, 0.25)}


def flags(spark, series, kind="w"):
    """series: lists of values, one a source; gives the flagged positions by source."""
    data = [(s, kind, i, v, "e") for s, xs in enumerate(series) for i, v in enumerate(xs)]
    d = spark.createDataFrame(data, "x int, kind string, seq int, v double, lo string").withColumn("day", F.date_add(F.lit("2150-01-01").cast("date"), F.col("seq") * 40).cast("timestamp_ntz"))
    f = flag_readings(d, ["x", "kind"], ["kind"], ["day", "seq"], "v", LIMITS, "day")
    return f


def noise(n, sd=1.0, level=200.0, seed=0):
    r = random.Random(seed)
    return [round(level + r.gauss(0, sd), 1) for _ in range(n)]


def test_impossible_spike_and_drift(spark):
    base = [noise(20, seed=s) for s in range(30)]
    base[0][7] = 0.0
    base[1][9] += 30
    base[2][5] += 30
    base[2][6] += 31
    base[3] = [v + i * 3 for i, v in enumerate(base[3])]
    base[4] = [v + (40 if i > 9 else 0) for i, v in enumerate(base[4])]
    data = [(s, "w", i, v) for s, xs in enumerate(base) for i, v in enumerate(xs)]
    d = spark.createDataFrame(data, "sid int, kind string, seq int, v double").withColumn("day", F.date_add(F.lit("2150-01-01").cast("date"), F.col("seq") * 40).cast("timestamp_ntz"))
    f = flag_readings(d, ["sid", "kind"], ["kind"], ["day", "seq"], "v", LIMITS, "day")
    assert rows(f.where("implausible"), "sid", "seq") == [(0, 7)]
    assert rows(f.where("spike"), "sid", "seq") == [(1, 9), (2, 5), (2, 6)]
    assert f.count() == 600


def made_up(seed, patients=800):
    """Series of 6 to 60 readings with their own level and scatter, a drift or a new level here and there, and planted spikes and stuck runs."""
    r = random.Random(seed)
    data, spikes, stuck = [], set(), set()
    for s in range(patients):
        n, sd = r.choice([6, 8, 10, 12, 15, 20, 30, 60]), 1.2 * math.exp(r.gauss(0, 0.5))
        level, drift = r.uniform(150, 250), r.choice([0, 0, 0, 0.2 * sd])
        jump = r.randrange(n) if r.random() < 0.1 else n
        xs = [level + drift * i + (15 * sd if i >= jump else 0) + r.gauss(0, sd) for i in range(n)]
        if r.random() < 0.3 and n > 8 and jump == n:
            at, w = r.randrange(3, n - 4), r.choice([1, 1, 2])
            for i in range(at, at + w):
                xs[i] += r.choice([-1, 1]) ** (i == at) * r.uniform(12, 25) * sd if w == 1 else 15 * sd
                spikes.add((s, i))
        elif r.random() < 0.05 and n > 12:
            at = r.randrange(2, n - 6)
            for i in range(at, at + 6):
                xs[i] = xs[at]
                stuck.add((s, i))
        data += [(s, "w", i, round(x, 1)) for i, x in enumerate(xs)]
    return data, spikes, stuck


def frame(spark, data):
    d = spark.createDataFrame(data, "sid int, kind string, seq int, v double")
    return d.withColumn("day", F.date_add(F.lit("2150-01-01").cast("date"), F.col("seq") * 40).cast("timestamp_ntz"))


def test_fitted_tails_find_what_was_planted(spark):
    for seed in (1, 2):
        data, spikes, stuck = made_up(seed)
        f = flag_readings(frame(spark, data), ["sid", "kind"], ["kind"], ["day", "seq"], "v", LIMITS, "day").cache()
        got, run = set(rows(f.where("spike"), "sid", "seq")), set(rows(f.where("stuck"), "sid", "seq"))
        assert len(got & spikes) >= 0.97 * len(spikes) and len(got & spikes) >= 0.97 * len(got), (len(got), len(spikes), len(got & spikes))
        assert stuck <= run and len(run - stuck) <= 0.02 * len(stuck)
        cut = [x[0] for x in rows(f.where("cutoff IS NOT NULL").select("sid", "cutoff").distinct(), "cutoff")]
        assert len(set(cut)) > 100 and 5 < sorted(cut)[len(cut) // 2] < 9  # each source its own, none a bound


def test_risk_moves_the_cutoff(spark):
    d = frame(spark, made_up(3, 60)[0])
    top = lambda risk: flag_readings(d, ["sid", "kind"], ["kind"], ["day", "seq"], "v", LIMITS, "day", SpikeRules(risk=risk)).agg(F.percentile("cutoff", F.lit(0.5))).first()[0]
    assert top(1e-2) < top(1e-4) < top(1e-6)


def test_stretches_of_a_hot_series_give_the_same_flags(spark):
    data, _, _ = made_up(4, 30)
    data += [(99, "w", i, 200 + random.Random(i).gauss(0, 1) + (30 if i % 41 == 7 else 0)) for i in range(300)] + [(99, "w", i, 2.0) for i in (300, 301)]
    cols = ["sid", "seq", "implausible", "spike", "stuck"]
    one, many = (rows(flag_readings(frame(spark, data), ["sid", "kind"], ["kind"], ["day", "seq"], "v", LIMITS, "day", SpikeRules(shard_rows=n)), *cols) for n in (10**6, 20))
    assert one == many and sum(x[3] for x in one) > 5


def test_a_season_is_no_spike(spark):
    """A month that is always higher counts as ordinary."""
    data = [(s, "w", i, round(200 + random.Random(s * 99 + i).gauss(0, 1) + (9 if i % 12 == 6 else 0), 1)) for s in range(60) for i in range(36)]
    d = spark.createDataFrame(data, "sid int, kind string, seq int, v double").withColumn("day", F.add_months(F.lit("2150-01-15").cast("date"), F.col("seq")).cast("timestamp_ntz"))
    f = flag_readings(d, ["sid", "kind"], ["kind"], ["day", "seq"], "v", LIMITS, "day")
    assert f.where("spike AND seq % 12 = 6").count() == 0


def test_stuck_only_where_values_usually_change(spark):
    xs = [noise(20, seed=s) for s in range(10)]
    xs[0][5:11] = [201.1] * 6
    xs[1][5:9] = [201.1] * 4
    data = [(s, "w", i, v) for s, x in enumerate(xs) for i, v in enumerate(x)] + [(99, "h", i, 66.0 if i % 9 else 66.25) for i in range(40)]
    d = spark.createDataFrame(data, "sid int, kind string, seq int, v double").withColumn("day", F.date_add(F.lit("2150-01-01").cast("date"), F.col("seq") * 40).cast("timestamp_ntz"))
    f = flag_readings(d, ["sid", "kind"], ["kind"], ["day", "seq"], "v", LIMITS, "day")
    assert set(rows(f.where("stuck"), "sid", "seq")) == {(0, i) for i in range(5, 11)}


def test_short_empty_null_duplicate_and_clashing(spark):
    f = flags(spark, [[200.0, 500.0, 200.0], [], [100.0] * 4])
    assert f.where("spike OR stuck").count() == 0 and f.count() == 7
    assert flags(spark, []).count() == 0
    data = [(1, "w", 1, None), (1, "w", 2, 100.0), (1, "w", 2, 100.0), (None, "w", 3, 100.0), (1, "unknown kind", 1, -5.0)]
    d = spark.createDataFrame(data, "sid int, kind string, seq int, v double").withColumn("day", F.lit("2150-01-01").cast("timestamp_ntz"))
    f = flag_readings(d, ["sid", "kind"], ["kind"], ["day", "seq"], "v", LIMITS, "day")
    assert f.count() == 2 and f.where("implausible").count() == 0


def test_all_numbers_of_a_text_are_judged(spark, tmp_path):
    texts = {
        "Weight (Lbs)": ["154.4 | 154.3", "154.4 | 1543", '"154,4";"9,3"'],
        "Blood Pressure": ["130/77 | 131/76", "130/77 | 76/131", "130/77, 131/76, 999/80", "130/77, 131", "77/77"],
    }
    data = [(n, k, i, v) for n, (k, vs) in enumerate(texts.items()) for i, v in enumerate(vs)]
    d = spark.createDataFrame(data, "subject_id int, result_name string, seq_num int, result_value string")
    d.withColumn("chartdate", F.lit("2150-01-01").cast("timestamp_ntz")).write.parquet(str(tmp_path / "omr.parquet"))
    f = omr_flags(spark, str(tmp_path))
    assert sorted(set(rows(f.where("implausible"), "subject_id", "seq_num"))) == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 4)] and f.select("subject_id", "seq_num").distinct().count() == 8

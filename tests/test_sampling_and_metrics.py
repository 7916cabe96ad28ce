import math
import random

import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayline.operators import budget as B
from stayline.operators import metrics as M
from stayline.operators import sampling as X


def test_weights_sum_to_one(spark):
    f = spark.createDataFrame([(i, p) for i in range(20) for p in range(1 + i % 5)], "s int, p int")
    w = X.rarity_weights(f, ["s"], "p")
    assert abs(w.agg(F.sum("weight")).first()[0] - 1) < 1e-9 and w.count() == 20


def test_draws_without_replacement(spark):
    d = spark.range(1000).withColumn("w", F.when(F.col("id") < 10, 0.0).otherwise(F.col("id").cast("double")))
    got = X.weighted_without_replacement(d, ["id"], "w", 200, "s")
    assert got.distinct().count() == 200 and got.where("w = 0").count() == 0 and got.agg(F.avg("id")).first()[0] > 560
    assert rows(got, "id") == rows(X.weighted_without_replacement(d.repartition(7), ["id"], "w", 200, "s"), "id")
    assert X.uniform_without_replacement(d, ["id"], 5000, "s").count() == 1000


def test_draws_with_replacement_follow_the_weights(spark):
    d = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0), (4, None)], "k int, w double")
    n = dict(rows(X.weighted_with_replacement(d, "k", "w", 4000, "s").groupBy("k").count()))
    assert sum(n.values()) == 4000 and set(n) == {1, 2} and abs(n[2] / 4000 - 0.75) < 0.03


@pytest.mark.parametrize("cap", [None, 7])
def test_balance_is_exact_with_a_hot_label(spark, cap):
    d = spark.range(3000).withColumn("l", F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") == 1, None).otherwise("hot"))
    assert rows(X.balance(d, "l", ["id"], "s", cap).groupBy("l").count()) == [("hot", cap or 30), ("rare", cap or 30)]
    assert X.balance(d.limit(0), "l", ["id"], "s").count() == 0


def test_choices_and_drops(spark):
    d = spark.range(4000)
    n = dict(rows(d.groupBy(X.choose(F.col("id"), "s", [("a", 0.5), ("b", 0.5)]).alias("c")).count()))
    assert abs(n["a"] - 2000) < 120
    m = spark.createDataFrame([(i, {"a": "1", "b": "2", "c": "3"}) for i in range(200)] + [(900, {}), (901, None)], "i int, m map<string,string>")
    s = [r[0] for r in m.orderBy("i").select(F.size(X.drop_entries(F.col("m"), F.col("i"), 0.9, "s"))).collect()]
    assert min(s[:200]) == 1 and s[200] == 0 and max(s[:200]) >= 2


def test_prf_rules(spark):
    d = spark.createDataFrame([(2, 1, 1), (0, 0, 0), (0, 3, 0)], "tp int, fp int, fn int")
    got = [tuple(r) for r in d.select(*M.prf(F.col("tp"), F.col("fp"), F.col("fn"))).collect()]
    assert got[0] == pytest.approx((2 / 3, 2 / 3, 2 / 3)) and all(math.isnan(x) for x in got[1]) and got[2] == (0.0, 0.0, 0.0)
    m = M.macro_micro(d).first()
    assert m.macro_f1 == pytest.approx(1 / 3) and m.micro_f1 == pytest.approx(4 / 9)


def test_auc(spark):
    r = random.Random(3)
    data = [(r.random() < 0.3, round(r.random(), 1)) for _ in range(200)]
    pos, neg = [s for g, s in data if g], [s for g, s in data if not g]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert M.auc_by_rank(spark.createDataFrame(data, "g boolean, s double"), [], "g", "s").first()[0] == pytest.approx(want)
    assert math.isnan(M.auc_by_rank(spark.createDataFrame([(True, 0.1)], "g boolean, s double"), [], "g", "s").first()[0])


def test_worst_case_and_accuracy(spark):
    d = spark.createDataFrame([(10.0, None, 0.0, 12.0), (None, 5.0, 0.0, 12.0), (1.0, 1.0, None, None), (2.0, None, None, None)], "g double, p double, lo double, hi double")
    assert rows(M.worst_case(d, "g", "p", "lo", "hi"), "g", "p", "skipped") == [(0.0, 5.0, False), (1.0, 1.0, False), (10.0, 0.0, False), (2.0, None, True)]
    w = spark.createDataFrame([("a", "a"), (None, None), ("a", None)], "g string, p string")
    assert w.agg(M.accuracy(F.col("g"), F.col("p"))).first()[0] == pytest.approx(2 / 3)
    assert math.isnan(w.limit(0).agg(M.accuracy(F.col("g"), F.col("p"))).first()[0])


def test_bleu(spark):
    d = spark.createDataFrame([("the cat sat on the mat", "the cat sat on the mat")], "r string, c string")
    assert M.corpus_bleu(d, "r", "c").first()[0] == pytest.approx(1.0)
    e = spark.createDataFrame([("a b c d e f", "a b c x e f")], "r string, c string")
    assert M.corpus_bleu(e, "r", "c", 1).first()[0] == pytest.approx(5 / 6)
    assert M.corpus_bleu(e, "r", "c", 4).first()[0] == 0.0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 200))
def test_level_is_the_largest(spark, lengths, limit):
    got = spark.createDataFrame([(lengths,)], "l array<int>").select(B.level(F.col("l"), F.lit(limit))).first()[0]
    want = max(lengths) if sum(lengths) <= limit else max(b for b in range(limit + 1) if sum(min(x, b) for x in lengths) <= limit)
    assert got == want


def test_budget_golden_and_cuts(spark):
    one = spark.range(1)
    assert one.select(B.level(F.array(F.lit(100), F.lit(50), F.lit(10)), F.lit(120))).first()[0] == 60
    assert one.select(B.shorten(F.array(F.lit("abcdef"), F.lit("xy")), F.lit(5))).first()[0] == ["def", "xy"]
    assert one.select(B.clamp_int8(F.array(F.lit(300.0), F.lit(-200.0), F.lit(-1.9)))).first()[0] == [127, -128, -1]
    assert one.select(B.summary_slice(F.sequence(F.lit(1), F.lit(20)))).first()[0] == list(range(11, 19))
    assert one.select(B.label_mask(F.array(F.lit(5), F.lit(6)), F.array(F.lit(7)))).first()[0] == [-100, -100, 7]


def test_row_numbers_and_shards(spark):
    d = spark.createDataFrame([(i % 7, i) for i in range(50)], "o int, t int")
    got = B.row_numbers(d, "o", "t").collect()
    assert [(r.o, r.t) for r in sorted(got, key=lambda r: r.rn)] == sorted((i % 7, i) for i in range(50)) and sorted(r.rn for r in got) == list(range(1, 51))
    w = dict(rows(B.worker_shards(spark.range(10).withColumnRenamed("id", "k"), "k", 4).groupBy("worker").count()))
    assert w == {0: 3, 1: 3, 2: 2, 3: 2}
    assert B.worker_shards(spark.range(0).withColumnRenamed("id", "k"), "k", 4).count() == 0


def test_split_sizes(spark):
    from stayline.operators.cohorts import rank_split

    d = spark.range(1000).withColumnRenamed("id", "k")
    got = rank_split(d.union(d), "k", "s")
    assert rows(got.groupBy("split").count()) == [("test", 25), ("train", 950), ("val", 25)]
    assert rows(got) == rows(rank_split(d.repartition(9), "k", "s"))
    assert rank_split(d.limit(0), "k", "s").count() == 0


def test_nothing_to_weigh(spark):
    f = spark.createDataFrame([(1, "a"), (2, "a")], "s int, p string")
    assert rows(X.rarity_weights(f, ["s"], "p"), "s", "weight") == [(1, None), (2, None)]
    assert rows(X.log_group_weights(f, "s"), "s", "p") == [(1, None), (2, None)]
    assert X.rarity_weights(f.limit(0), ["s"], "p").count() == 0

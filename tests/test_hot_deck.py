import pytest
from helpers import rows
from pyspark.sql import functions as F

from stayline.operators.hot_deck import Feature, Target, hot_deck, missing_codes, number, usable

SCHEMA = "s int, i int, at double, num double, txt string, extra string"


def fill(spark, data, **kw):
    return hot_deck(spark.createDataFrame(data, SCHEMA), ["s", "i"], "at", [Target("v", "num", "txt")], **({"wide": ["i"]} | kw))


def test_placeholders_and_findings(spark):
    words = ["None", "Absent", "7", "n/a", " N/A ", "--", "___", "", "  ", None, "null", "not recorded", "NaN", "漢"]
    d = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, v string")
    assert [r[0] for r in d.orderBy("i").select(usable(F.col("v"))).collect()] == [True] * 3 + [False] * 10 + [True]
    assert [r[0] for r in d.orderBy("i").select(number(F.col("v"))).collect()][2] == 7.0


def test_closest_donors_weigh_most(spark):
    got = fill(spark, [(1, 1, 0.0, 10.0, None, "a"), (1, 1, 1.0, None, None, "b"), (1, 1, 1.1, 20.0, None, "c"), (1, 1, 9.0, 30.0, None, "d")]).where("v_missing").first()
    assert got.v_num == 20.0 and got.v_filled and got.v_level == "block" and sorted(got.v_donors) == [0.0, 1.1, 9.0] and got.extra == "b"


def test_majority_and_ties(spark):
    got = fill(spark, [(1, 1, 0.0, None, "x", None), (1, 1, 1.0, None, None, None), (1, 1, 2.0, None, "y", None)]).where("v_missing").first()
    assert got.v_txt == "x"
    got = fill(spark, [(1, 1, 0.0, None, "x", None), (1, 1, 1.0, None, None, None), (1, 1, 2.0, None, "y", None), (1, 1, 2.0, None, "y", None)]).where("v_missing").first()
    assert got.v_txt == "y"


def test_wide_group_then_nothing(spark):
    data = [(1, 1, 0.0, None, None, None), (2, 1, 0.0, 4.0, None, None), (3, 1, 0.0, 6.0, None, None), (4, 1, 0.0, 8.0, None, None), (5, 2, 0.0, None, None, None)]
    got = {r.s: r for r in fill(spark, data).collect()}
    assert got[1].v_num == 6.0 and got[1].v_level == "wide" and got[1].v_donors is None
    assert got[5].v_missing and not got[5].v_filled and got[5].v_num is None
    assert not got[2].v_missing and got[2].v_num == 4.0 and not got[2].v_filled


def test_nulls_in_block_or_place(spark):
    data = [(None, 1, 0.0, None, None, None), (1, 1, None, None, None, None), (1, 1, None, 5.0, None, None), (1, None, 1.0, None, None, None), (2, 1, 3.0, 7.0, None, None)]
    got = fill(spark, data)
    assert got.count() == 5 and {r.v_level for r in got.where("v_missing AND i = 1").collect()} == {"wide"}
    assert got.where("i IS NULL").first().v_filled is False


def test_only_missing_duplicates_empty(spark):
    data = [(1, 1, float(t), None if t % 5 == 0 else float(t), None, None) for t in range(60)] * 2
    whole, few = fill(spark, data), fill(spark, data, only_missing=True, shard_rows=9)
    assert whole.count() == 120 and few.count() == 24 and few.where("v_filled").count() == 24
    assert fill(spark, []).count() == 0 and fill(spark, [], only_missing=True).count() == 0


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("size", [1, 7, 40])
def test_stretches_of_hot_blocks_give_the_same_fills(spark, few, size):
    """Donors behind the bounds of a stretch count, over stretches with few donors or none."""
    import random

    r = random.Random(size)
    data = [(s, 1, r.uniform(-90, 90), r.choice([None, None, r.uniform(0, 9)]), r.choice([None, None, None, "x", "y"]), str(n)) for s in range(8) for n in range(60)]
    data += [(9, 1, 1.0, 4.0, None, "a"), (9, 1, 99.0, None, None, "b"), (10, 1, 5.0, None, None, "c")]
    cols = ["s", "extra", "v_num", "v_txt", "v_donors", "v_level", "v_filled"]
    whole = rows(fill(spark, data, only_missing=few), *cols)
    assert rows(fill(spark, data, shard_rows=size, only_missing=few), *cols) == whole
    got = {x[1]: x for x in whole}
    assert got["b"][2] == 4.0 and got["b"][5] == "block" and got["c"][5] == "wide"


def test_mixed_features_decide_between_donors(spark):
    """Of donors about equally far in position, the ones that share the other features are used."""
    data = [(1, 1, 1.0, 10.0, None, "x"), (1, 1, 2.0, 10.0, None, "x"), (1, 1, 3.0, None, None, "y"), (1, 1, 4.1, 50.0, None, "y"), (1, 1, 5.1, 50.0, None, "y")]
    plain, mixed = (fill(spark, data, features=f, donors=2, only_missing=True).first() for f in ([], [Feature("category", "extra", weight=3.0)]))
    assert plain.v_num == 10.0 and mixed.v_num == 50.0 and mixed.v_donors == [4.1, 5.1]
    clock = fill(spark, [(1, 1, float(t), float(t % 24), None, None if t % 24 == 6 else "x") for t in range(96) if t != 54] + [(1, 1, 54.0, None, None, None)], features=[Feature("cycle", scale=24.0, weight=0.5), Feature("number", "at", scale=10.0)], only_missing=True).first()
    assert abs(clock.v_num - 6) <= 1
    with pytest.raises(ValueError):
        fill(spark, data, features=[Feature("nope", "extra")])


def test_codes_and_words_are_inferred(spark):
    data = [(g, str(v), 5) for g in range(6) for v in range(60, 90)] + [(g, w, 1) for g in range(5) for w in ("--x--", "-9999", "777777")] + [(2, "999999", 1), (2, "130", 1), (7, "None", 99), (7, "Warm", 5), (7, "999999", 1), (None, "1", 1)]
    c = missing_codes(spark.createDataFrame(data, "g int, t string, n int"), "g", "t", "n").first()
    assert c.words == ["--x--"] and c.numbers == [-9999.0, 777777.0, 999999.0] and (2, 999999.0) in c.codes and len(c.codes) == 11
    none = missing_codes(spark.createDataFrame([], "g int, t string, n int"), "g", "t", "n").first()
    assert (none.words, none.numbers, none.codes) == ([], [], [])


def test_old_result_columns_are_replaced(spark):
    d = spark.createDataFrame([(1, 1, 0.0, 1.0, None, "e")], SCHEMA).withColumn("v_num", F.lit("old"))
    assert hot_deck(d, ["s", "i"], "at", [Target("v", "num", "txt")]).first().v_num == 1.0


def test_held_out_values_are_near(spark):
    """Of a smooth series, hidden readings come back within its step."""
    import math

    data = [(1, 1, float(t), None if t % 7 == 3 else 80 + 10 * math.sin(t / 9), None, str(80 + 10 * math.sin(t / 9))) for t in range(300)]
    err = fill(spark, data).where("v_missing").select(F.avg(F.abs(F.col("v_num") - F.col("extra").cast("double")))).first()[0]
    assert err < 10 / 9  # the largest step; a weighted median takes one of the neighbours
    with pytest.raises(ValueError):
        hot_deck(spark.range(1), ["nope"], "id", [Target("v", "id")])

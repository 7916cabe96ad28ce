import pandas as pd
import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stayline.operators import common as C


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), max_size=40, unique=True))
def test_sharded_neighbours_equal_plain_windows(spark, data):
    d = spark.createDataFrame(data, "k string, o int").withColumn("s", F.floor(F.col("o") / 7))
    what = {f"b{i}": ("o", -i) for i in (1, 2, 3)} | {f"a{i}": ("o", i) for i in (1, 2, 3)}
    w = Window.partitionBy("k").orderBy("o")
    want = d.select("k", "o", *[F.lag("o", i).over(w).alias(f"b{i}") for i in (1, 2, 3)], *[F.lead("o", i).over(w).alias(f"a{i}") for i in (1, 2, 3)])
    got = C.sharded_neighbours(d, ["k"], ["o"], "s", what, 3)
    assert rows(got, *want.columns) == rows(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    big = spark.createDataFrame([("h", i) for i in range(50)] + [("x", 1), ("x", 1), (None, 2)], "k string, v int")
    small = spark.createDataFrame([("h", 7), ("y", 8)], "k string, w int")
    assert rows(C.salted_join(big, small, ["k"], how)) == rows(big.join(small, ["k"], how))


def test_salted_join_refuses_outer(spark):
    with pytest.raises(ValueError):
        C.salted_join(spark.range(1), spark.range(1), ["id"], "full_outer")


def test_join_dimension_is_exact_on_either_side_of_the_bound(spark):
    a = spark.createDataFrame(pd.DataFrame({"k": [1, 2, 2, 3], "v": list("abcd")}))
    b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, w string")
    assert rows(C.join_dimension(a, b, ["k"])) == rows(C.join_dimension(a, b, ["k"], max_rows=1))


def test_cut_lineage_uses_the_shared_folder(spark):
    d = C.cut_lineage(spark.range(3))
    assert d.count() == 3 and spark.sparkContext.getCheckpointDir()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="nope"):
        C.require(spark.range(1), ["nope"])

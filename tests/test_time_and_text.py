from helpers import rows
from pyspark.sql import functions as F

from stayline.functions import icd, numeric, text
from stayline.functions import time as T


def ts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", F.col("t").cast("timestamp_ntz").alias("t"))


def test_hours_round_half_even(spark):
    d = ts(spark, "2150-01-01 00:30:00", "2150-01-01 01:30:00", "2150-01-01 02:30:00.000001", "1960-01-01 00:30:00", None)
    assert [r[0] for r in d.orderBy("i").select(T.stamp(T.hour_round("t"))).collect()] == ["2150-01-01 00:00:00", "2150-01-01 02:00:00", "2150-01-01 03:00:00", "1960-01-01 00:00:00", None]


def test_floor_ceil_months(spark):
    d = ts(spark, "2150-12-31 23:59:59.999999")
    got = d.select(T.stamp(T.hour_floor("t")), T.stamp(T.hour_ceil("t")), T.stamp(T.month_start(T.month_index("t"))), T.hours_between("t", "t")).first()
    assert tuple(got) == ("2150-12-31 23:00:00", "2151-01-01 00:00:00", "2150-12-01 00:00:00", 0.0)


def test_numbers(spark):
    d = spark.createDataFrame([(" 5 ",), ("x",), ("nan",), (None,)], "v string")
    assert [r[0] for r in d.select(numeric.to_number(F.col("v"))).collect()] == [5.0, None, None, None]
    e = spark.createDataFrame([(80.0, 0.0, 100.0), (-5.0, 0.0, 100.0), (1.0, 2.0, 2.0), (None, 0.0, 1.0)], "v double, a double, b double")
    assert [r[0] for r in e.select(numeric.text_of(F.col("v"))).collect()] == ["80", "-5", "1", None]
    assert [r[0] for r in e.select(numeric.min_max(F.col("v"), F.col("a"), F.col("b"))).collect()][1:3] == [0.0, None]


def test_codes(spark):
    d = spark.createDataFrame([("25000",), ("4019",), ("V5861",), ("3195",), (None,)], "c string")
    assert [r[0] for r in d.select(icd.icd_chapter(F.col("c"))).collect()] == ["endocrine", "circulatory", None, None, None]
    one = spark.range(1)
    assert one.select(icd.ndc_key(F.lit(2143380)), icd.ndc_product_key(F.lit("0002-1433"))).first()[:] == ("000021433", "000021433")
    assert one.select(icd.tagged_parts(F.lit("a [EPC], b,c [EPC]"))).first()[0] == ["a [EPC]", "c [EPC]"]
    assert one.select(icd.tagged_parts(F.lit(None).cast("string"))).first()[0] is None


def test_sections(spark):
    d = spark.createDataFrame([("A\nFINDINGS: x\nIMPRESSION: y\nmore\nIMPRESSION: z",), ("x\nFINDINGS: only",), ("plain",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(text.impression(F.col("t"))).collect()] == ["z", "only", "plain", "", None]
    assert rows(d.select(text.last_match(F.col("t"), r"IMPRESSION: (\w)"))) == [("z",), (None,), (None,), (None,), (None,)]
    m = spark.createDataFrame([("3mm 4cm",), ("4cm",)], "t string")
    assert [r[0] for r in m.select(text.strip_unit(F.col("t"))).collect()] == ["3 4cm", "4"]


def test_codes_in_words(spark):
    from stayline.functions.codes import INTERPRETATIONS, SERVICES, in_words

    d = spark.createDataFrame([("S", "MED"), ("Q", "XYZ"), (None, None)], "i string, s string")
    assert rows(d.select(in_words(F.col("i"), INTERPRETATIONS), in_words(F.col("s"), SERVICES, keep=True))) == [("sensitive", "Medical"), (None, "XYZ"), (None, None)]

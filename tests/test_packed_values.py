import pytest
from helpers import rows

from stayline.operators.packed_values import infer_delimiters, split_packed


def split(spark, texts, extra=(), **kw):
    base = ["1/2", "3/4", "120/80"] * 10 + ["1;2", "3;4", "5, 6", "7, 8", "9|10", '"1,5";"1,6"', '"2,5","2,6"']
    d = spark.createDataFrame([("s", i, t) for i, t in enumerate(list(texts) + base)], "src string, id int, t string")
    v = split_packed(d, ["src"], "t", **kw).where(f"id < {len(texts)}")
    out = [[] for _ in texts]
    for r in sorted(v.collect(), key=lambda r: (r.id, r.value_pos)):
        out[r.id].append(r.value_text)
    return out


def test_delimiters_quotes_and_trailing(spark):
    texts = ["120/80", " 106 / 78/", '"19,6";"19,7"', '"19,6","19,7","19,8"', "'104';'70'", "22.7 | 22.6|", "1/2;3/4", "-5/6", "18"]
    want = [["120", "80"], ["106", "78"], ["19,6", "19,7"], ["19,6", "19,7", "19,8"], ["104", "70"], ["22.7", "22.6"], ["1", "2", "3", "4"], ["-5", "6"], ["18"]]
    assert split(spark, texts) == want


def test_remarks_nulls_words(spark):
    assert split(spark, ["98 (estimate; see lab note)", "refused", "", None, "97, adjusted for body surface", "x" * 100_000]) == [["98"], [], [], [], ["97"], []]


def test_min_values_duplicates_and_new_names(spark):
    d = spark.createDataFrame([("s", "1/2", "old")] * 2 + [("s", "5", "old"), (None, "1/2", "o")], "src string, t string, value_text string")
    v = split_packed(d, ["src"], "t", min_values=2)
    assert rows(v, "value_pos", "value_text") == [(1, "1"), (1, "1"), (2, "2"), (2, "2")] and v.columns.count("value_text") == 1
    assert split_packed(d.limit(0), ["src"], "t").count() == 0
    with pytest.raises(ValueError):
        split_packed(d, ["nope"], "t")


def test_scores_per_source_and_key_names(spark):
    d = spark.createDataFrame([("a", "1/2")] * 5 + [("b", "1;2")] * 5 + [("b", "see a/b and c/d")] * 20, "name string, t string")
    got = {r.name: r.delimiters for r in infer_delimiters(d, ["name"], "t").collect()}
    assert got["a"] == ["slash"] and "semicolon" in got["b"]

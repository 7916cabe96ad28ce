import pytest
from helpers import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stayline.operators.regular_grid import regular_grid

SCHEMA = "k string, p long, v double, o long"


def brute(data):
    out = []
    for k in {r[0] for r in data if r[0] is not None and r[1] is not None}:
        by = {}
        for kk, p, v, o in data:
            if kk == k and p is not None:
                by.setdefault(p, []).append((o, v))
        last = None
        for p in range(min(by), max(by) + 1):
            known = sorted(x for x in by.get(p, []) if x[1] is not None)
            v = known[-1][1] if known else None
            last = v if v is not None else last
            out.append((k, p, v, len(by.get(p, [])), last, p not in by))
    return sorted(out, key=repr)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-20, 40)), st.one_of(st.none(), st.sampled_from([1.0, 2.0, 3.0])), st.integers(0, 3)), max_size=25), st.sampled_from([1, 5, 1000]))
def test_equals_brute_force(spark, data, shard):
    assert rows(regular_grid(spark.createDataFrame(data, SCHEMA), ["k"], "p", "v", "o", shard)) == brute(data)


def test_gap_over_empty_shards(spark):
    got = rows(regular_grid(spark.createDataFrame([("a", 0, 1.0, 0), ("a", 30, 2.0, 0)], SCHEMA), ["k"], "p", "v", "o", 7))
    assert len(got) == 31 and sum(r[5] for r in got) == 29 and {r[4] for r in got if r[5]} == {1.0}


def test_empty_and_key_names(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert rows(regular_grid(d, ["k"], "p", "v")) == []
    with pytest.raises(ValueError):
        regular_grid(d.withColumnRenamed("k", "period"), ["period"], "p", "v")
    assert regular_grid(d.withColumnRenamed("k", "shard"), ["shard"], "p", "v").columns[0] == "shard"

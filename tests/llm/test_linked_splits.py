import random
from collections import Counter

import pytest
from helpers import rows
from pyspark.sql import functions as F

from stayline.llm.linked_splits import hash_to_min, linked_split, rendezvous, shared_key_edges


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(1, 1), (2, 3), (3, 2), (2, 3)], [(random.Random(1).randrange(60), random.Random(i).randrange(60)) for i in range(30)]])
def test_components_equal_union_find(spark, pairs):
    got = dict(rows(hash_to_min(spark.createDataFrame(pairs, "a int, b int")), "node", "component"))
    assert got == brute(pairs)


def test_no_edges_and_nulls(spark):
    assert rows(hash_to_min(spark.createDataFrame([(1, None), (None, 2)], "a int, b int"))) == []


def test_shared_keys_make_stars(spark):
    links = spark.createDataFrame([(i, 1) for i in range(5)] + [(7, 2), (7, 2), (8, None), (None, 1)], "p int, k int")
    assert rows(shared_key_edges(links, "p", "k")) == [(0, i) for i in range(1, 5)]


def test_linked_records_share_a_split(spark):
    comp = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node int, component int")
    d = spark.createDataFrame([(i, "old") for i in (1, 2, 3, 4, 4, None)], "p int, split string")
    got = linked_split(d, "p", comp, {"a": 0.5, "b": 0.5})
    by = {}
    for r in got.collect():
        by.setdefault(r.p, set()).add((r.component, r.split))
    assert got.count() == 6 and by[1] == by[2] == by[3] and len(by[4]) == 1 and by[None] == {(None, None)}


def test_rendezvous_shares_and_stability(spark):
    d = spark.range(20000)
    n = Counter(dict(rows(d.groupBy(rendezvous(F.col("id"), {"train": 0.95, "validation": 0.025, "test": 0.025}).alias("s")).count())))
    assert abs(n["train"] / 20000 - 0.95) < 0.006 and abs(n["test"] / 20000 - 0.025) < 0.004
    moved = d.where(rendezvous(F.col("id"), {"a": 1, "b": 1}) != rendezvous(F.col("id"), {"a": 1, "b": 1, "c": 0})).count()
    assert moved == 0
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), {})
    assert d.limit(3).select(rendezvous(F.col("id"), {"only": 1.0}).alias("s")).distinct().count() == 1

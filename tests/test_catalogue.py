"""Every registered query of the core against its SQL on the smallest tables, and the driver's contract."""

import os

import pytest
from helpers import duck_of, same_rows

import __spark_entry__
from stayline.plans import catalogue_history, catalogue_ingest, catalogue_joins, catalogue_more, catalogue_records, catalogue_rest, catalogue_samples, catalogue_visits, data_problems

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = [data_problems, catalogue_history, catalogue_ingest, catalogue_joins, catalogue_more, catalogue_records, catalogue_rest, catalogue_samples, catalogue_visits, catalogue_rest]
QUERIES = {n: f for m in MODULES for n, f in m.R.queries.items()}
ORACLE = {n: s for m in MODULES for n, s in m.R.oracle.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return duck_of(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_nested_text_returns_all_facts(spark):
    assert QUERIES["yaml_roundtrip"](spark, SF).where("NOT same").count() == 0


def test_simulation_rolls_every_item_on(spark):
    got = QUERIES["simulate_stub"](spark, SF)
    want = catalogue_samples.readings(spark, SF).where("v IS NOT NULL").select("stay_id", "itemid").distinct()
    assert want.select("itemid").distinct().count() > 1
    assert sorted(map(tuple, got.select("stay_id", "itemid").collect())) == sorted(map(tuple, want.collect()))

"""Every registered query of the subpackage that has SQL against it on the smallest tables; the others run."""

import os

import pytest
from helpers import duck_of, same_rows

from stayline.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return duck_of(SF)


@pytest.mark.parametrize("name", sorted(queries.R.oracle))
def test_equals_sql(spark, duck, name):
    same_rows(queries.R.queries[name](spark, SF), duck, queries.R.oracle[name])


@pytest.mark.parametrize("name", sorted(set(queries.R.queries) - set(queries.R.oracle)))
def test_runs(spark, name):
    assert queries.R.queries[name](spark, SF).count() >= 0

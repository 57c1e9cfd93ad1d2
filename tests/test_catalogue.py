import pytest

from tests.conftest import DATA, plain
from textloom.plans import more, places, wider  # noqa: F401  register their queries
from textloom.plans.catalogue import ORACLES, QUERIES

SF = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, small, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(small.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns

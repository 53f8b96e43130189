"""Every query of the catalogue against its SQL."""

import pytest
from compare import DATA, connection, difference

from tidewell import catalog


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert difference(df.collect(), df.columns, con, catalog.SQL[name]) == ([], [])


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert len(e.entry(spark).collect()) > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_prunes_and_pushes_down(spark):
    plan = catalog.QUERIES["search_parts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "p_retailprice" in plan
    assert "TakeOrderedAndProject" in plan

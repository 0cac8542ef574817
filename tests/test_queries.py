"""Every registered query against its check SQL on the smallest tables."""

import pytest
from checks import compare, duck

from ledgerlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    if q.sql:
        assert compare(df, con, q.sql) is None
    else:
        assert df.count() >= 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns
    assert set(e.oracle_sql()) <= set(e.queries())

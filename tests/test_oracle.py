"""Every closed-form query equals its DuckDB oracle (sf0.001; the driver checks sf0.01)."""

import pytest
from conftest import SF_SMALL
from oracle_harness import compare, duck

from __spark_entry__ import oracle_sql, queries

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, queries()[name], ORACLE[name], SF_SMALL)
    assert r["ok"], r


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["outer", "auc"]
    assert df.count() == 5

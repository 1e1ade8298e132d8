"""Every registered query with an oracle equals DuckDB on sf0.001 (the sf0.01 run is tests/parity.py)."""

import pytest

import __spark_entry__ as E
from parity import compare, duck
from testdata import SF_SMALL

ORACLE = E.oracle_sql()
SLOW = {"stream_insert"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(k for k in ORACLE if k not in SLOW))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], ORACLE[key], SF_SMALL)
    assert r["ok"], r


def test_every_query_registered_with_entry(spark):
    assert set(ORACLE) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() > 0

"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate), plus the smoke entry at sf0.001."""

import pytest

import __spark_entry__ as E
from conftest import SF_CHECK
from oracle import compare, duck_conn
from tillroll.plans import registry

QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_conn(SF_CHECK)


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLES))
    assert not missing, missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problems, n = compare(spark, con, name, SF_CHECK, QUERIES, ORACLES)
    assert not problems, problems

"""Every registered query against its SQL in DuckDB, on whole tables."""

import pytest
from oracle import compare, duck

from millrace.plans.catalog import entry, oracle_sql, queries

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    rows, _, types = compare(spark, con, name, queries()[name], ORACLES[name], sf_dir)
    assert rows > 0
    same = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: b for c, (a, b) in types.items() if same.get(a, a) != b} == {}


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    """Queries whose values no SQL gives: they run on whole tables and have rows and a stable schema."""
    first = queries()[name](spark, "/root/testdata/sf0.001")
    assert first.count() > 0 and len(set(first.columns)) == len(first.columns)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(queries())


def test_entry(spark):
    assert entry(spark, "/root/testdata/sf0.001").count() == 2

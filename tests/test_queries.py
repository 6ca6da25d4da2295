"""Every registered query with SQL gives the same rows in both engines; the others give rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, FOLDER, name, QUERIES[name], ORACLES.get(name))
    assert not result.endswith(" 0") or name in ORACLES


def test_entry(spark):
    rows = {r.severity: r for r in entry.entry(spark).collect()}
    assert set(rows) >= {"CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

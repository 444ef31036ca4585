"""Every registered query against its check SQL on the smallest data set."""

import compare
import pytest

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return compare.connect(data)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_check_sql(spark, data, con, name):
    assert compare.compare(QUERIES[name](spark, data), con, CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["recommendation", "turns", "avg_risk"]

"""Every registered query against its SQL statement, in another engine."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.oracle import ORACLE_SQL
from fieldkin.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(small):
    return connect(small)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(contract.queries()) >= set(QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_statement(spark, db, small, name):
    assert compare(spark, db, small, name) is None


def test_the_flagship_query(spark):
    result = contract.entry(spark)
    assert result.count() == 51

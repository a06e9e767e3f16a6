"""Every named query that can be said in SQL gives the rows of its SQL."""

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    good, message, _, _ = compare(spark, duck, name, FOLDER, entry.queries(), entry.oracle_sql())
    assert good, message


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

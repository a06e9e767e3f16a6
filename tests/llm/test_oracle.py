"""Queries against their SQL, over whole small tables."""

import pytest

import argotlog.llm.catalog as llm
from tests.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_equals_sql(spark, name):
    good, message, rows, _ = compare(spark, connect(FOLDER), name, FOLDER, llm.QUERIES, llm.SQL)
    assert good and rows, message


def test_every_operator_has_one_query():
    import __spark_entry__ as entry

    numbers = sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and {*llm.QUERIES, "pipeline"} <= entry.queries().keys()

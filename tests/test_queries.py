"""Registered queries against their SQL, at the smallest size."""

import pytest

from tests.oracle import compare
from tidemark.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, name, Q.QUERIES[name], Q.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every core query with SQL agrees with it on the smallest tables."""

import os

import pytest
from oracle import SF, check

from rambleweave import queries

SLOW = {"g11_pagerank_by_joins"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(set(queries.SQL) - SLOW))
def test_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name])


def test_names():
    assert set(queries.SQL) <= set(queries.QUERIES)

import os

import pytest
from oracle import SF, check

from rambleweave.llm import queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.SQL[name])

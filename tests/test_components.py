import random

import pytest

from rambleweave.operators.components import components


def brute(edges):
    up = {}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        if a is None or b is None:
            continue
        up.setdefault(a, a), up.setdefault(b, b)
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("local", [10**6, 0])
def test_against_union_find(spark, local):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(20)] + [(7, None), (500, 500)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {x.id: x.component for x in components(df, local_edges=local).collect()} == brute(edges)


def test_empty(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0

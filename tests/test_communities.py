import pytest

from rambleweave.operators import community
from rambleweave.operators.graph import LinkGraph, documents

SCHEMA = "id string, refs array<string>"


def linked(spark, refs):
    return LinkGraph(documents(spark.createDataFrame(list(refs.items()), SCHEMA)))


def clique(c, n=4):
    return {f"{c}{i}": [f"{c}{j}" for j in range(1, n + 1) if j != i] for i in range(1, n + 1)}


@pytest.mark.parametrize("limit", [0, 3])
def test_parallel_finds_the_cliques(spark, limit):
    refs = {**clique("A"), **clique("B"), "orphan": []}
    refs["A4"] = refs["A4"] + ["B1"]
    got = community.communities(linked(spark, refs), seed=42, kernel_edges=limit)
    assert {tuple(r.nodes) for r in got.communities.collect()} == {("A1", "A2", "A3", "A4"), ("B1", "B2", "B3", "B4")}


def test_parallel_goes_on_to_the_end(spark):
    """A path needs aggregation: single nodes cease to gain long before the communities are large enough."""
    g = linked(spark, {f"n{i:03}": [f"n{i + 1:03}"] if i < 47 else [] for i in range(48)})
    q = lambda **k: community.communities(g, **k).modularity.first().modularity
    assert q(kernel_edges=40) > q() - 0.01

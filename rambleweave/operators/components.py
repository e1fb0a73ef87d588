"""Connected components of an undirected graph.

Few edges (a checked number) are solved by union-find in one task. More are contracted in rounds of large-star and
small-star: neighbours are linked to the smallest node around instead of to each other, until every component is a
star. Each round is two aggregations by node and is checkpointed; a node with very many neighbours only ever takes
part in grouped minima and joins, never in a collected list.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut

#: Edges up to which one task solves the graph: 16 bytes each for numbers, some tens for strings.
LOCAL_EDGES = 1_000_000


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    up: dict = {}

    def find(x: object) -> object:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for a, b in zip(pdf["a"], pdf["b"]):
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    return pd.DataFrame({"id": nodes, "component": [find(x) for x in nodes]})


def components(edges: DataFrame, a: str = "a", b: str = "b", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Columns id, component for each node of an edge; component is the smallest id in it.

    Direction, repeated edges and loops make no difference (a node with a loop only is its own component); edges with
    a null end are dropped; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    kind = e.schema["a"].dataType.simpleString()
    if e.count() <= local_edges:
        return e.groupBy().applyInPandas(_union_find, f"id {kind}, component {kind}")
    nodes = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct()
    e = e.where("a <> b")
    last = None
    while True:
        # large-star: every larger neighbour of a node is linked to the smallest around it
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        # small-star: every smaller neighbour, and the node, is linked to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = cut(small)
        # distinct edges: the same number, and none that was not there
        size = e.count()
        if last is not None and size == last[1] and e.join(last[0], ["a", "b"], "left_anti").isEmpty():
            break
        last = e, size
    return nodes.join(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))

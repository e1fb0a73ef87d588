"""How two nodes are related, and what is to be said of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import summary, title_or_id
from ..plans.durable import cut
from .activation import pageranks
from .graph import LinkGraph

DECAY = 0.7
WITNESSES = 3


def shortest_path(graph: LinkGraph, start: str, end: str) -> list[str] | None:
    """Ids of the smallest of the shortest paths; None if there is none or an end is unknown.

    Levels are joins from both ends, the smaller one next, until they meet or one finds nothing new. A node's
    neighbours are a level before, beside or after it, so a new level is compared with two others only.
    """
    if graph.nodes.where(F.col("id").isin(start, end)).count() < len({start, end}):
        return None
    if start == end:
        return [start]
    s = graph.docs.sparkSession
    first = lambda key: s.createDataFrame([(key, [key])], "id string, path array<string>")
    # of each end: its last two levels, and how many nodes the last one has; paths run from the start to the end
    levels, sizes = [[None, first(start)], [None, first(end)]], [1, 1]
    while True:
        side = 0 if sizes[0] <= sizes[1] else 1
        before, now = levels[side]
        step = now.join(graph.edges, now["id"] == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("near"))
        old = now.select("id") if before is None else now.select("id").union(before.select("id"))
        path = F.concat("near", F.array("id")) if side == 0 else F.concat(F.array("id"), "near")
        fresh = cut(step.join(old, "id", "left_anti").select("id", path.alias("path")))
        levels[side] = [now, fresh]
        ahead, back = levels[0][1], levels[1][1].select("id", F.col("path").alias("rest"))
        whole = ahead.join(back, "id").select(F.concat("path", F.slice("rest", 2, F.size("rest"))).alias("path"))
        found = fresh.agg(F.count("*").alias("n")).join(whole.agg(F.min("path").alias("path")), F.lit(True), "left").first()  # one row each
        if found["path"] is not None:
            return list(found["path"])
        if not found["n"]:
            return None
        sizes[side] = found["n"]


def evidence(graph: LinkGraph, path: list[str]) -> DataFrame:
    """pos, a, b, witnesses for each edge of a path: titles, at most three, of the ends whose own references name the other end by its id."""
    s = graph.docs.sparkSession
    steps = s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]))], "pos int, a string, b string")
    own = graph.docs.where(F.col("id").isin(*path)).select("id", title_or_id(F.col("title"), F.col("id")).alias("title"), "refs")  # the nodes of one path
    x, y = own.select(F.col("id").alias("a"), F.col("title").alias("ta"), F.col("refs").alias("ra")), own.select(F.col("id").alias("b"), F.col("title").alias("tb"), F.col("refs").alias("rb"))
    said = F.array(F.when(F.array_contains("ra", F.col("b")), F.col("ta")), F.when(F.array_contains("rb", F.col("a")), F.col("tb")))
    names = F.slice(F.array_sort(F.array_distinct(F.filter(said, lambda t: t.isNotNull()))), 1, WITNESSES)
    return steps.join(x, "a").join(y, "b").select("pos", "a", "b", names.alias("witnesses"))


def relation(graph: LinkGraph, start: str, end: str) -> DataFrame:
    """One row: start, end, hops, direct, activation, ppr_there, ppr_back, affinity, path. Unreachable: hops and activation -1, no path. A node to itself: 0 hops, activation 1. An unknown end gives no row."""
    s = graph.docs.sparkSession
    schema = "start string, end string, hops int, direct boolean, activation double, ppr_there double, ppr_back double, affinity double, path array<string>"
    if graph.nodes.where(F.col("id").isin(start, end)).count() < len({start, end}):
        return s.createDataFrame([], schema)
    if start == end:
        p = 1.0 / graph.size
        return s.createDataFrame([(start, end, 0, False, 1.0, p, p, p, [start])], schema)
    path = shortest_path(graph, start, end)
    hops = len(path) - 1 if path else -1
    both = {r["id"]: r for r in pageranks(graph, [start, end]).where(F.col("id").isin(start, end)).collect()}
    there, back = both[end]["p0"], both[start]["p1"]
    return s.createDataFrame([(start, end, hops, hops == 1, DECAY**hops if path else -1.0, there, back, (there + back) / 2, path or [])], schema)


def node_detail(graph: LinkGraph, key: str) -> DataFrame:
    """One row: id, title, type, path, aliases, tags, summary (200 characters), text_len, truncated, deg, neighbours and backlinks (structs title, id, type; by title). Backlinks are the documents whose own references hold the id, itself among them. An unknown key gives no row."""
    ref = lambda df: F.array_sort(F.collect_list(F.struct("title", "id", "type")))
    near = graph.neighbours(key)
    near = near.agg(ref(near).alias("neighbours"))
    back = graph.docs.where(F.array_contains("refs", F.lit(key))).select("title", "id", "type")
    back = back.agg(ref(back).alias("backlinks"))
    own = graph.docs.where(F.col("id") == key).join(graph.nodes.select("id", "deg"), "id")
    size = F.char_length("text")
    one = own.select("id", "title", "type", "path", "aliases", "tags", summary(F.col("text")).alias("summary"), size.alias("text_len"), (size > 200).alias("truncated"), "deg", F.lit(1).alias("_"))
    return one.join(near.withColumn("_", F.lit(1)), "_").join(back.withColumn("_", F.lit(1)), "_").drop("_")

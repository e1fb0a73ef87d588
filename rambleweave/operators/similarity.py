"""Structural similarity of nodes and links that might be missing.

Over all nodes, pairs are found in tasks that hold the graph (wedges), up to a checked size. Beyond it, and for a few nodes,
common neighbours are an equi-join of the edges with themselves on the shared neighbour. A neighbour of degree d takes
part in d * d pairs, which is the work all pairs ask for; rows of a hub are split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut
from . import wedges
from .graph import LinkGraph

ADAMIC_ADAR, JACCARD, ALLOCATION = 1.0, 0.5, 1.0
PER_ANCHOR = 2
ALGORITHMS = ["aa", "jaccard", "ra"]


def common_neighbours(graph: LinkGraph, left: DataFrame | None = None, kernel_edges: int = wedges.KERNEL_EDGES) -> DataFrame:
    """a, b, aa, ra, n, shared for each node a of left (column id; else of all that may be presented) and each other node b with neighbours in common. shared is sorted."""
    if left is None and wedges.fits(graph, kernel_edges):
        return wedges.common(graph)
    left = graph.nodes.where(graph.presentable()) if left is None else left
    mid = graph.edges.join(graph.nodes.select(F.col("id").alias("src"), F.greatest("deg", F.lit(2)).alias("d")), "src").select(F.col("src").alias("mid"), F.col("dst").alias("b"), "d")
    own = graph.edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("mid"))
    pairs = own.join(mid, "mid").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.sum(1 / F.log("d")).alias("aa"), F.sum(1 / F.col("d")).alias("ra"), F.count("*").alias("n"), F.array_sort(F.collect_set("mid")).alias("shared"))


def shared_neighbours(graph: LinkGraph, pairs: DataFrame) -> DataFrame:
    """a, b, shared (sorted) of some pairs."""
    left = pairs.select("a", "b").join(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("mid")), "a")
    both = left.join(graph.edges.select(F.col("src").alias("b"), F.col("dst").alias("mid")), ["b", "mid"])
    return both.groupBy("a", "b").agg(F.array_sort(F.collect_list("mid")).alias("shared"))


def similar_to(graph: LinkGraph, keys: DataFrame | None = None, k: int = 10, kernel_edges: int = wedges.KERNEL_EDGES) -> DataFrame:
    """key, id, title, type, score, shared: for each node of keys (column id; else of all) the k nodes with the highest Adamic-Adar score that aren't linked to it and may be presented. By joins, scores first; what is shared only of the best."""
    if keys is None and wedges.fits(graph, kernel_edges):
        found = wedges.best(graph, k, potential=False).select(F.col("a").alias("key"), F.col("b").alias("id"), "score", "shared")
        return found.join(graph.nodes.select("id", "title", "type"), "id").select("key", "id", "title", "type", "score", "shared")
    keys = graph.nodes if keys is None else keys
    shown = graph.nodes.where(graph.presentable()).select(F.col("id").alias("b"), "title", "type")
    weight = graph.nodes.select(F.col("id").alias("src"), (1 / F.log(F.greatest("deg", F.lit(2)))).alias("aa"))
    mid = graph.edges.join(weight, "src").select(F.col("src").alias("mid"), F.col("dst").alias("b"), "aa").join(shown.select("b"), "b", "left_semi")
    own = graph.edges.join(keys.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("mid"))
    scored = own.join(mid, "mid").where("a <> b").groupBy("a", "b").agg(F.round(F.sum("aa"), 12).alias("score")).where("score > 0")
    apart = scored.join(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    best = apart.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("rn") <= k)
    best = cut(best.join(shown, "b").select("a", "b", "title", "type", "score"))
    return best.join(shared_neighbours(graph, best), ["a", "b"]).select(F.col("a").alias("key"), F.col("b").alias("id"), "title", "type", "score", "shared")


def similar(graph: LinkGraph, key: str, k: int = 10) -> DataFrame:
    """id, title, type, score, shared of similar_to for one key. k of 0 or less counts as 10; an unknown or isolated key gives nothing."""
    found = similar_to(graph, graph.nodes.where(F.col("id") == key), k if k > 0 else 10)
    return found.drop("key").orderBy(F.desc("score"), "id")


def potential_links(graph: LinkGraph, per_anchor: int = PER_ANCHOR, kernel_edges: int = wedges.KERNEL_EDGES) -> DataFrame:
    """a, b (a < b), score, algorithms, shared: of every presentable node the best unlinked ones two steps away. Suggestions are never added to the graph. By joins, each pair is scored once; what is shared comes of the best only."""
    if wedges.fits(graph, kernel_edges):
        found = wedges.best(graph, per_anchor, potential=True).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", "shared")
        return found.groupBy("a", "b").agg(F.max("score").alias("score"), F.max("shared").alias("shared")).select("a", "b", "score", F.array(*map(F.lit, ALGORITHMS)).alias("algorithms"), "shared")
    shown = graph.nodes.where(graph.presentable()).select("id", "deg")
    weight = graph.nodes.select(F.col("id").alias("src"), F.greatest("deg", F.lit(2)).alias("d"))
    own = graph.edges.join(shown.select(F.col("id").alias("dst"), F.col("deg").alias("da")), "dst").select(F.col("src").alias("mid"), F.col("dst").alias("a"), "da")
    other = own.select("mid", F.col("a").alias("b"), F.col("da").alias("db")).join(weight.withColumnRenamed("src", "mid"), "mid")
    found = own.join(other, "mid").where("a < b").groupBy("a", "b").agg(F.first("da").alias("da"), F.first("db").alias("db"), F.sum(1 / F.log("d")).alias("aa"), F.sum(1 / F.col("d")).alias("ra"), F.count("*").alias("n"))
    found = found.join(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    score = ADAMIC_ADAR * F.col("aa") + JACCARD * F.col("n") / (F.col("da") + F.col("db") - F.col("n")) + ALLOCATION * F.col("ra")
    # Sums differ in their last digits by the order of their terms; equal scores must stay equal.
    scored = found.select("a", "b", F.round(score, 12).alias("score"))
    ends = scored.select("a", "b", "score", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"))
    best = ends.withColumn("rn", F.row_number().over(Window.partitionBy("e.x").orderBy(F.desc("score"), "e.y"))).where(F.col("rn") <= per_anchor)
    pairs = cut(best.select("a", "b", "score").distinct())
    return pairs.join(shared_neighbours(graph, pairs), ["a", "b"]).select("a", "b", "score", F.array(*map(F.lit, ALGORITHMS)).alias("algorithms"), "shared")


def suggest_links(graph: LinkGraph, k: int = 50) -> DataFrame:
    """The k best potential links with the titles of both ends."""
    top = potential_links(graph).orderBy(F.desc("score"), "a", "b").limit(k)
    title = graph.nodes.select("id", "title")
    return top.join(title.select(F.col("id").alias("a"), F.col("title").alias("a_title")), "a").join(title.select(F.col("id").alias("b"), F.col("title").alias("b_title")), "b").select("a", "a_title", "b", "b_title", "score", "algorithms", "shared")

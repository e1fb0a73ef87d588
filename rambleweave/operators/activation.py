"""Spreading from seeds over the graph: personalised PageRank and bounded activation.

PageRank is 60 rounds over all edges. A graph of few enough edges (a checked number) runs as one numpy kernel inside
the plan; beyond it the rounds are joins on edges that are partitioned once by their source, with lineage cut every
few rounds. Activation takes at most a handful of rounds and is always one plan of joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut, shuffle_partitions
from .graph import LinkGraph

TELEPORT, ROUNDS = 0.15, 60
#: Directed edges up to which one task runs all rounds: two numbers of eight bytes each, once their ids are numbered.
KERNEL_EDGES = 4_000_000
CUT_EVERY = 10


def pagerank(graph: LinkGraph, seeds: DataFrame, teleport: float = TELEPORT, rounds: int = ROUNDS, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """id, ppr of every node: from 1/N everywhere, each round a node passes (1 - teleport) of its mass to its neighbours and the seeds share teleport.

    seeds: column id. The mass of an isolated node is lost, so an isolated seed ends at its share of teleport and
    other isolated nodes at 0. Seeds that are no nodes and repeated ones don't count; without seeds, no mass is added.
    """
    seeds = graph.nodes.select("id").join(seeds.select("id").distinct(), "id", "left_semi").withColumn("seed", F.lit(True))
    k = seeds.count()
    share = 1.0 / k if k else 0.0
    weighted = graph.nodes.select("id", "deg").join(seeds, "id", "left").select("id", "deg", F.when(F.col("seed"), share).otherwise(0.0).alias("w0"))
    return _spread(graph, weighted, 1, teleport, rounds, kernel_edges).withColumnRenamed("p0", "ppr")


def pageranks(graph: LinkGraph, starts: list[str], teleport: float = TELEPORT, rounds: int = ROUNDS, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """id, p0, p1, ...: the PageRanks of several nodes, each by itself the seed, in one run."""
    weighted = graph.nodes.select("id", "deg", *[(F.col("id") == s).cast("double").alias(f"w{i}") for i, s in enumerate(starts)])
    return _spread(graph, weighted, len(starts), teleport, rounds, kernel_edges)


def _spread(graph: LinkGraph, nodes: DataFrame, k: int, teleport: float, rounds: int, kernel_edges: int) -> DataFrame:
    """id, p0, ... for k columns of seeds' shares (w0, ...) of all nodes (id, deg)."""
    n, edges = graph.size, graph.edges
    w, p = [f"w{i}" for i in range(k)], [f"p{i}" for i in range(k)]
    alone = [F.coalesce(a, teleport * F.col(b)).alias(a) for a, b in zip(p, w)]
    if graph.edge_count <= kernel_edges:

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            src, ids = pd.factorize(pdf["src"], sort=True)
            dst = ids.get_indexer(pdf["dst"])
            deg = np.bincount(src, minlength=len(ids))
            out = {"id": ids}
            for a, b in zip(p, w):
                share = np.zeros(len(ids))
                share[src] = pdf[b]
                at = np.full(len(ids), 1.0 / n)
                for _ in range(rounds):
                    at = (1 - teleport) * np.bincount(dst, (at / deg)[src], minlength=len(ids)) + teleport * share
                out[a] = at
            return pd.DataFrame(out)

        ranked = edges.join(nodes.select(F.col("id").alias("src"), *w), "src").groupBy().applyInPandas(kernel, "id string, " + ", ".join(f"{a} double" for a in p))
        return nodes.join(ranked, "id", "left").select("id", *alone)
    parts = shuffle_partitions(edges.sparkSession)
    fixed = cut(edges.join(nodes.select(F.col("id").alias("src"), "deg"), "src").repartition(parts, "src"))
    linked = cut(nodes.where("deg > 0").select("id", *w).repartition(parts, "id"))
    at = linked.select("id", *[F.lit(1.0 / n).alias(a) for a in p])
    for r in range(1, rounds + 1):
        moved = fixed.join(at, fixed["src"] == at["id"]).groupBy("dst").agg(*[F.sum(F.col(a) / F.col("deg")).alias(f"got_{a}") for a in p])
        at = linked.join(moved, linked["id"] == moved["dst"]).select("id", *[((1 - teleport) * F.col(f"got_{a}") + teleport * F.col(b)).alias(a) for a, b in zip(p, w)])
        if r % CUT_EVERY == 0:
            at = cut(at)
    return nodes.join(at, "id", "left").select("id", *alone)


def levels(decay: float, least: float, most_hops: int) -> list[float]:
    """Activation by hops, as far as it spreads; by repeated multiplication."""
    out = [1.0]
    while len(out) <= most_hops and out[-1] >= least and out[-1] * decay >= least:
        out.append(out[-1] * decay)
    return out


def activate(graph: LinkGraph, seeds: DataFrame, decay: float = 0.7, least: float = 0.1, most_hops: int = 3) -> DataFrame:
    """id, act, hops, path of every node that activation reaches: decay to the power of the hops to the nearest seed, while it is at least `least`. path is the smallest of the shortest ones. Seeds have 1 and 0 hops."""
    seeded = graph.nodes.select("id").join(seeds.select("id").distinct(), "id", "left_semi")
    strength = levels(decay, least, most_hops)
    # One plan for all hops: a handful at most, and what is known of a node only ever gets an earlier hop or a smaller path.
    found = seeded.select("id", F.struct(F.lit(0).alias("hops"), F.array("id").alias("path")).alias("way"))
    for hop in range(1, len(strength)):
        last = found.where(F.col("way.hops") == hop - 1).select(F.col("id").alias("src"), F.col("way.path").alias("before"))
        step = last.join(graph.edges, "src").groupBy(F.col("dst").alias("id")).agg(F.min("before").alias("before"))
        step = step.select("id", F.struct(F.lit(hop).alias("hops"), F.concat("before", F.array("id")).alias("path")).alias("way"))
        found = found.unionByName(step).groupBy("id").agg(F.min("way").alias("way"))
    act = F.element_at(F.array(*map(F.lit, strength)), F.col("way.hops") + 1)
    return found.select("id", act.alias("act"), "way.hops", "way.path")

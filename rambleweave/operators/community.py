"""Communities by modularity.

A graph of few enough edges (a checked number) is one task's: the Leiden method of Traag, Waltman and van Eck (2019),
with fast local moving, refinement within communities and aggregation. Beyond that, nodes move in parallel rounds of joins until none gains and are aggregated by communities,
without refinement, until the aggregated graph is small enough for that task. Every round raises modularity: if moving many nodes at once does not, only moves are made that share no
community, whose gains hold side by side.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_or_id
from ..plans.durable import cut, shuffle_partitions
from .graph import LinkGraph

KERNEL_EDGES = 5_000_000
TOP_TITLES = 8


class _Level:
    """A weighted graph of one level: neighbours' weights, and twice the weight inside of each node. Node v's neighbours are near[starts[v]:starts[v + 1]], in arrays, as lists of dictionaries take tens of times the memory; weight is None where all are 1."""

    def __init__(self, starts: np.ndarray, near: np.ndarray, weight: np.ndarray | None, inner: np.ndarray):
        self.starts, self.near, self.weight, self.inner = starts.tolist(), near, weight, inner
        sums = np.diff(starts).astype(float) if weight is None else np.bincount(np.repeat(np.arange(len(inner)), np.diff(starts)), weight, len(inner))
        self.degree = (sums + inner).tolist()

    @staticmethod
    def of(src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None, inner: np.ndarray) -> _Level:
        """From edges in both directions, in any order; those of the same ends add up."""
        n = len(inner)
        keys = src.astype(np.int64) * n + dst
        if weight is None:
            keys.sort()
        else:
            order = np.argsort(keys, kind="stable")
            keys, weight = keys[order], weight[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            keys, weight = keys[first], np.add.reduceat(weight, first) if len(first) else weight
        return _Level(np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) * n), (keys % max(n, 1)).astype(np.int32), weight, inner)

    def around(self, v: int) -> Iterable[tuple[int, float]]:
        a, b = self.starts[v], self.starts[v + 1]
        return zip(self.near[a:b].tolist(), repeat(1.0) if self.weight is None else self.weight[a:b].tolist())


def _move(g: _Level, label: list[int], total: float, resolution: float, rng: random.Random) -> None:
    """Fast local moving: a queue of nodes, each put where modularity gains most."""
    weight = [0.0] * len(label)
    for v, c in enumerate(label):
        weight[c] += g.degree[v]
    order = list(range(len(label)))
    rng.shuffle(order)
    queue, waiting = deque(order), set(order)
    while queue:
        v = queue.popleft()
        waiting.discard(v)
        own, d = label[v], g.degree[v]
        to: dict[int, float] = {own: 0.0}
        for u, w in g.around(v):
            c = label[u]
            to[c] = to.get(c, 0.0) + w
        weight[own] -= d
        pull = resolution * d
        best, most = own, to[own] - pull * weight[own] / total + 1e-12
        for c in sorted(to):
            gain = to[c] - pull * weight[c] / total
            if gain > most:
                best, most = c, gain + 1e-12
        weight[best] += d
        if best != own:
            label[v] = best
            for u, _ in g.around(v):
                if label[u] != best and u not in waiting:
                    waiting.add(u)
                    queue.append(u)


def _refine(g: _Level, label: list[int], total: float, resolution: float, rng: random.Random) -> list[int]:
    """Split each community into well-connected parts: nodes that are still alone join a part of their community that gains."""
    part = list(range(len(label)))
    weight, size = list(g.degree), [1] * len(label)
    order = list(range(len(label)))
    rng.shuffle(order)
    for v in order:
        if size[part[v]] > 1:
            continue
        to: dict[int, float] = {}
        for u, w in g.around(v):
            if label[u] == label[v]:
                to[part[u]] = to.get(part[u], 0.0) + w
        gains = [(w - resolution * g.degree[v] * weight[c] / total, -c) for c, w in to.items() if c != part[v]]
        if gains and max(gains)[0] > 1e-12:
            c = -max(gains)[1]
            weight[c] += g.degree[v]
            size[c] += 1
            weight[v], size[v], part[v] = 0.0, 0, c
    return part


def leiden(edges: list[tuple[int, int]] | np.ndarray, n: int, resolution: float, seed: int) -> list[int]:
    """Community of each of n nodes for undirected edges (each once)."""
    rng = random.Random(seed)
    e = np.asarray(edges, np.int64).reshape(-1, 2)
    g = _Level.of(np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]]), None, np.zeros(n))
    return _leiden(g, list(range(n)), sum(g.degree) or 1.0, resolution, rng)


def _leiden(g: _Level, label: list[int], total: float, resolution: float, rng: random.Random) -> list[int]:
    """Community of each node of g, from the communities in label on. total: twice the weight of all edges, also of those that are not in g."""
    where = list(range(len(label)))
    while True:
        _move(g, label, total, resolution, rng)
        if len(set(label)) == len(label):
            break
        part = _refine(g, label, total, resolution, rng)
        number = {c: k for k, c in enumerate(sorted(set(part)))}
        if len(number) == len(part):  # nothing to aggregate by parts: aggregate by communities
            part, number = label, {c: k for k, c in enumerate(sorted(set(label)))}
        to, outer = np.array([number[c] for c in part]), [0] * len(number)
        for v, c in enumerate(to.tolist()):
            outer[c] = label[v]
        src, dst = np.repeat(to, np.diff(g.starts)), to[g.near]
        weight = np.ones(len(dst)) if g.weight is None else g.weight
        inside = src == dst
        inner = np.bincount(to, g.inner, len(number)) + np.bincount(src[inside], weight[inside], len(number))
        src, dst, weight = src[~inside], dst[~inside], weight[~inside]
        where = [number[part[v]] for v in where]
        again = {c: k for k, c in enumerate(sorted(set(outer)))}
        g, label = _Level.of(src, dst, weight, inner), [again[c] for c in outer]
    return [label[v] for v in where]


@dataclass
class Communities:
    """membership: id, community (numbered from 0 by size, then smallest id). communities: community, size, nodes, top_titles; its nodes are whole lists, as the result asks for, so membership is the form for large ones. modularity: one row."""

    membership: DataFrame
    communities: DataFrame
    modularity: DataFrame


def communities(graph: LinkGraph, resolution: float = 1.0, seed: int = 1, kernel_edges: int = KERNEL_EDGES) -> Communities:
    """Communities of the linked nodes; isolated ones are in none. A resolution of 0 or less counts as 1."""
    resolution = resolution if resolution > 0 else 1.0
    once = graph.edges.where("src < dst")
    m = once.count()
    if m <= kernel_edges:

        def kernel(rows: pa.Table) -> pa.Table:
            ids = pc.unique(pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks], pa.string())).sort()
            number = lambda c: pc.index_in(rows[c], value_set=ids).to_numpy()
            found = leiden(np.column_stack([number("src"), number("dst")]), len(ids), resolution, seed)
            return pa.table({"id": ids, "label": pa.array(found, pa.int64())})

        labels = once.groupBy().applyInArrow(kernel, "id string, label long").withColumn("label", F.col("label").cast("string"))
    else:
        labels = _parallel(graph, m, resolution, seed, kernel_edges)
    labels = cut(labels)
    sized = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    # The place of a community is the number of those before it; equal sizes are told apart by the smallest id. Ranges of communities are numbered by themselves, after those of the ranges before.
    ranges = cut(sized.repartitionByRange(shuffle_partitions(sized.sparkSession), F.desc("size"), "first").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("start"))  # one row per partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("size"), "first")) + F.col("start") - 1
    numbered = ranges.join(F.broadcast(starts), "part").select("label", place.cast("int").alias("community"))
    member = cut(labels.join(numbered, "label").select("id", "community"))
    named = member.join(graph.nodes, "id").select("community", "id", "deg", title_or_id(F.col("title"), F.col("id")).alias("name"))
    best = named.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("deg"), "id"))).where(F.col("rn") <= TOP_TITLES)
    tops = best.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("top_titles"))
    listed = member.groupBy("community").agg(F.count("*").cast("int").alias("size"), F.array_sort(F.collect_list("id")).alias("nodes")).join(tops, "community")
    return Communities(member, listed, modularity(graph, member, resolution))


def modularity(graph: LinkGraph, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity: over communities, their share of the edges less resolution times the square of their share of the degrees. 0 without edges."""
    side = lambda c: membership.select(F.col("id").alias(c), F.col("community").alias(f"{c}_in"))
    e = graph.edges.join(side("src"), "src").join(side("dst"), "dst")
    total = graph.edges.agg(F.count("*").alias("two_m"))
    per = e.groupBy(F.col("src_in").alias("community")).agg(F.count("*").alias("degree"), F.count_if(F.col("src_in") == F.col("dst_in")).alias("inside"))
    q = F.sum(F.col("inside") / F.col("two_m") - resolution * F.pow(F.col("degree") / F.col("two_m"), F.lit(2.0)))
    return per.join(F.broadcast(total)).agg(F.coalesce(q, F.lit(0.0)).alias("modularity"))  # total is one row


def _quality(edges: DataFrame, state: DataFrame, two_m: float, resolution: float) -> float:
    """Modularity of the labels of state, but for the constant weight inside of nodes."""
    side = lambda c: state.select(F.col("id").alias(c), F.col("label").alias(f"{c}_in"))
    inside = edges.join(side("src"), "src").join(side("dst"), "dst").where("src_in = dst_in").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    return inside / two_m - resolution * state.groupBy("label").agg(F.sum("deg").alias("t")).agg(F.sum(F.pow(F.col("t") / two_m, F.lit(2.0)))).first()[0]


def _rounds(edges: DataFrame, state: DataFrame, two_m: float, resolution: float, seed: int) -> DataFrame:
    """state (id, deg, label) after parallel moves until no node gains. edges: src, dst, w, in both directions."""
    quality, r = _quality(edges, state, two_m, resolution), 0
    while True:
        weight = state.groupBy("label").agg(F.sum("deg").alias("total"))
        own = state.join(weight, "label").select("id", "deg", F.col("label").alias("own"), (F.col("total") - F.col("deg")).alias("rest"))
        to = edges.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("w"))
        scored = to.join(weight.select("label", "total"), "label").join(own, "id")
        home = F.col("label") == F.col("own")
        gain = F.col("w") - resolution * F.col("deg") * F.col("total") / two_m
        best = scored.groupBy("id", "own", "deg", "rest").agg(F.max(F.when(~home, F.struct(gain.alias("gain"), "label"))).alias("best"), F.coalesce(F.max(F.when(home, F.col("w"))), F.lit(0.0)).alias("kept"))
        more = F.col("best.gain") - (F.col("kept") - resolution * F.col("deg") * F.col("rest") / two_m)
        # The margin is above what sums of doubles lose.
        gains = best.withColumn("more", more).where(F.col("more") > 1e-12 * F.greatest(F.lit(1.0), "deg"))
        wishes = cut(gains.select("id", "own", F.col("best.label").alias("new"), "more"))
        if wishes.isEmpty():
            return state

        def moved(moves: DataFrame, state: DataFrame = state) -> DataFrame:
            return cut(state.join(moves.select("id", "new"), "id", "left").select("id", "deg", F.coalesce("new", "label").alias("label")))

        # By the toss of a coin a community either gives or takes, so none that is joined is left in the same round.
        coin = lambda c, k=r: F.pmod(F.xxhash64(F.col(c), F.lit(seed + k)), F.lit(2))
        many = moved(wishes.where((coin("own") == 0) & (coin("new") == 1)))
        after = _quality(edges, many, two_m, resolution)
        if after <= quality + 1e-12:
            rank: Column = F.struct("more", "id")
            first = wishes.select(F.explode(F.array("own", "new")).alias("label"), rank.alias("rank")).groupBy("label").agg(F.max("rank").alias("first"))
            at = lambda c: first.select(F.col("label").alias(c), F.col("first.id").alias(f"{c}_first"))  # noqa: B023, E731
            many = moved(wishes.join(at("own"), "own").join(at("new"), "new").where("id = own_first and id = new_first"))
            after = _quality(edges, many, two_m, resolution)
        state, quality, r = many, after, r + 1


def _parallel(graph: LinkGraph, m: int, resolution: float, seed: int, kernel_edges: int) -> DataFrame:
    """id, label by moves over the whole graph until no node gains, and aggregation, again and again; from kernel_edges on by Leiden in one task."""
    two_m = 2.0 * m
    edges = cut(graph.edges.select("src", "dst", F.lit(1.0).alias("w")))
    state = cut(graph.nodes.where("deg > 0").select("id", F.col("deg").cast("double").alias("deg"), F.col("id").alias("label")))
    where = state.select("id", F.col("id").alias("node"))
    while True:
        if edges.count() // 2 <= kernel_edges:
            state = _solved(edges, state, two_m, resolution, seed)
            break
        state = _rounds(edges, state, two_m, resolution, seed)
        n = state.count()
        if state.select("label").distinct().count() == n:
            break
        parts = cut(state.select("id", F.col("label").alias("part")))
        part = lambda c: parts.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"))  # noqa: B023, E731
        edges = cut(edges.join(part("src"), "src").join(part("dst"), "dst").where("src_part <> dst_part").groupBy(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).agg(F.sum("w").alias("w")))
        where = cut(where.join(part("node"), "node").select("id", F.col("node_part").alias("node")))
        state = cut(state.join(parts, "id").groupBy(F.col("part").alias("id")).agg(F.sum("deg").alias("deg"), F.min("label").alias("label")))
    return where.join(state.select(F.col("id").alias("node"), "label"), "node").select("id", "label")


def _solved(edges: DataFrame, state: DataFrame, two_m: float, resolution: float, seed: int) -> DataFrame:
    """state with the labels that Leiden gives in one task. Nodes without edges, which are communities by themselves, stay out of it."""
    linked = edges.select(F.col("src").alias("id")).distinct()
    rows = edges.where("src < dst").select("src", "dst", "w", F.lit(True).alias("edge")).unionByName(state.join(linked, "id").select(F.col("id").alias("src"), F.col("label").alias("dst"), F.col("deg").alias("w"), F.lit(False).alias("edge")))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        nodes, links = pdf[~pdf["edge"]], pdf[pdf["edge"]]
        ids = list(nodes["src"])
        number = {x: k for k, x in enumerate(ids)}
        called = {x: k for k, x in enumerate(sorted(set(nodes["dst"])))}
        a, b, w = links["src"].map(number).to_numpy(np.int64), links["dst"].map(number).to_numpy(np.int64), links["w"].to_numpy(float)
        g = _Level.of(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), np.zeros(len(ids)))
        own = nodes["w"].to_numpy(float)
        g.inner, g.degree = own - np.array(g.degree), own.tolist()
        found = _leiden(g, [called[x] for x in nodes["dst"]], two_m, resolution, random.Random(seed))
        least: dict[int, str] = {}
        for x, c in zip(ids, found):
            least.setdefault(c, x)
        return pd.DataFrame({"id": ids, "label": [least[c] for c in found]})

    solved = cut(rows.groupBy().applyInPandas(kernel, "id string, label string"))
    return state.drop("label").join(solved, "id", "left").select("id", "deg", F.coalesce("label", "id").alias("label"))


def trimmed(found: Communities, top: int = 10, node: str | None = None) -> DataFrame:
    """The first communities (0: all), or only that of a node."""
    listed = found.communities
    if node is not None:
        return listed.join(found.membership.where(F.col("id") == node).select("community"), "community", "left_semi")
    return listed if top <= 0 else listed.where(F.col("community") < top)

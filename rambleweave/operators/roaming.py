"""From a query to a ranked cluster of related nodes, and random starts."""

from __future__ import annotations

import random
from collections import deque
from dataclasses import dataclass
from math import floor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import cut
from .activation import activate, pagerank
from .anchors import decorate, resolve, text_search
from .graph import LinkGraph

QUOTA = (0.5, 0.3, 0.2)


@dataclass(frozen=True)
class RoamOptions:
    top: int = 15
    hops: int = 3
    decay: float = 0.7
    least: float = 0.1
    alpha: float = 0.5
    beta: float = 0.5


@dataclass
class Outcome:
    """anchors: id, title, type, level, deg. results: pos, id, title, type, score, ppr, act, hops, path. fallback: 0 none, 1 nothing named, 2 nothing left; then hits holds id, title, type, count."""

    anchors: DataFrame
    results: DataFrame
    fallback: int
    hits: DataFrame
    random: bool = False


def quota_plan(n: int, available: list[int]) -> list[int]:
    """How many rows each bucket gives, of n in all; nothing is moved between buckets if the rounded shares already make n."""
    plan = [floor(n * share + 0.5) for share in QUOTA]
    while sum(plan) != n:
        if sum(plan) < n:
            short = next((b for b in range(3) if plan[b] < available[b]), None)
            if short is None:
                break
            plan[short] += 1
        else:
            over = next((b for b in (2, 1, 0) if plan[b] > available[b]), None)
            over = next(b for b in (2, 1, 0) if plan[b] > 0) if over is None else over
            plan[over] -= 1
    return plan


def interleaved(n: int, available: list[int]) -> list[tuple[int, int]]:
    """(bucket, row within it), both from 1, in the order of the output: buckets take turns as long as they have rows and quota."""
    left = [min(p, a) for p, a in zip(quota_plan(n, available), available)]
    taken, out = [0, 0, 0], []
    for i in range(n):
        bucket = next((b for b in ((i + k) % 3 for k in range(3)) if taken[b] < left[b]), None)
        if bucket is None:
            break
        taken[bucket] += 1
        out.append((bucket + 1, taken[bucket]))
    return out


def rank(graph: LinkGraph, act: DataFrame, ppr: DataFrame, exclude: DataFrame, n: int = 15, alpha: float = 0.5, beta: float = 0.5) -> DataFrame:
    """The n best of what is activated and not excluded (ids): scores are ppr and activation, scaled within the buckets of 1, 2 and more hops, and buckets take turns by quota."""
    bucket = F.least(F.greatest(F.col("hops"), F.lit(1)), F.lit(3))
    cand = cut(act.join(exclude.select("id").distinct(), "id", "left_anti").join(ppr, "id", "left").na.fill(0.0, ["ppr"]).withColumn("bucket", bucket))
    bounds = {r["bucket"]: r for r in cand.groupBy("bucket").agg(F.count("*").alias("n"), F.min("ppr").alias("p0"), F.max("ppr").alias("p1"), F.min("act").alias("a0"), F.max("act").alias("a1")).collect()}  # three rows
    order = interleaved(n, [bounds[b]["n"] if b in bounds else 0 for b in (1, 2, 3)])
    score = F.lit(None).cast("double")
    for b, r in bounds.items():
        scaled = lambda c, lo, hi: (F.col(c) - lo) / (hi - lo) if hi > lo else F.lit(0.5)
        score = F.when(F.col("bucket") == b, alpha * scaled("ppr", r["p0"], r["p1"]) + beta * scaled("act", r["a0"], r["a1"])).otherwise(score)
    place = Window.partitionBy("bucket").orderBy(F.desc("score"), "id")
    best = cand.withColumn("score", score).withColumn("rn", F.row_number().over(place)).where(F.col("rn") <= n)
    positions = graph.docs.sparkSession.createDataFrame([(b, k, i) for i, (b, k) in enumerate(order)], "bucket int, rn int, pos int")
    chosen = best.join(F.broadcast(positions), ["bucket", "rn"])  # n rows
    return chosen.join(graph.nodes, "id").select("pos", "id", "title", "type", "score", "ppr", "act", "hops", "path")


def cluster(graph: LinkGraph, seeds: DataFrame, options: RoamOptions) -> DataFrame:
    """Results for seeds. Seeds, hubs and structural nodes are left out of them, but ppr and activation pass through."""
    ppr = pagerank(graph, seeds)
    act = activate(graph, seeds, options.decay, options.least, options.hops)
    out = graph.nodes.where(graph.is_hub() | graph.is_structural()).select("id").union(seeds.select("id"))
    return rank(graph, act, ppr, out, options.top, options.alpha, options.beta)


def _empty(graph: LinkGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    s: SparkSession = graph.docs.sparkSession
    return (
        s.createDataFrame([], "id string, title string, type string, level int, deg int"),
        s.createDataFrame([], "pos int, id string, title string, type string, score double, ppr double, act double, hops int, path array<string>"),
        s.createDataFrame([], "id string, title string, type string, count int"),
    )


def roam(graph: LinkGraph, query: str, options: RoamOptions = RoamOptions()) -> Outcome:
    """The cluster around all nodes that a query names.

    A blank query gives nothing. Where it names nothing, the hits are texts that hold it (fallback 1); where the
    cluster is empty, texts that hold it, or the title of the one node that a number names, and that aren't
    structural (fallback 2; the limit of twice the top comes first).
    """
    nothing, no_results, no_hits = _empty(graph)
    if not query.strip():
        return Outcome(nothing, no_results, 0, no_hits)
    anchors = cut(decorate(resolve(graph.docs, query), graph.nodes))
    first = anchors.limit(2).collect()
    if not first:
        return Outcome(nothing, no_results, 1, text_search(graph.docs, query, 2 * options.top))
    results = cut(cluster(graph, anchors, options))
    if not results.isEmpty():
        return Outcome(anchors, results, 0, no_hits)
    text = query
    if len(first) == 1 and first[0]["title"] and query.strip().isascii() and query.strip().isdigit():
        text = first[0]["title"]
    hits = text_search(graph.docs, text, 2 * options.top)
    return Outcome(anchors, results, 2, hits.where(~graph.is_structural()))


def roll_pool(graph: LinkGraph, avoid: list[str] | tuple[str, ...] = (), alpha: float = 0.5) -> DataFrame:
    """id, w of the nodes a random start may pick; w is the degree to the power of alpha."""
    pool = graph.nodes.where(graph.presentable())
    if avoid:
        pool = pool.where(~F.col("id").isin(*avoid))
    return pool.select("id", F.pow("deg", F.lit(float(alpha))).alias("w"))


def roll_seed(graph: LinkGraph, u: float, avoid: list[str] | tuple[str, ...] = (), alpha: float = 0.5) -> str | None:
    """The start that a number u of [0, 1) picks: the first id, in order, at which the weights so far reach u of their sum.

    The sum so far is not run through one task: the pool is split into ranges of ids, whose sums say which range
    holds the start, and only that range is summed up.
    """
    pool = cut(roll_pool(graph, avoid, alpha))
    parts = pool.repartitionByRange(max(1, pool.count() // 100_000), "id").withColumn("part", F.spark_partition_id())
    parts = cut(parts)
    sums = sorted(tuple(r) for r in parts.groupBy("part").agg(F.sum("w"), F.min("id")).collect())  # one row per 100,000
    total = sum(w for _, w, _ in sums)
    if not total:
        return None
    aim, before = u * total, 0.0
    for part, w, _ in sums:
        if before + w >= aim or part == sums[-1][0]:
            running = F.sum("w").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
            rows = parts.where(F.col("part") == part).withColumn("run", running + before)
            row = rows.where(F.col("run") >= aim).orderBy("id").first() or rows.orderBy(F.desc("id")).first()
            return row["id"]
        before += w
    return None


class RandomWalks:
    """Random starts of a session; the last ones are avoided unless a seed is given."""

    def __init__(self, graph: LinkGraph, remembered: int = 32):
        self.graph = graph
        self.recent: deque[str] = deque(maxlen=remembered)

    def roam(self, seed: int | None = None, alpha: float = 0.5, options: RoamOptions = RoamOptions()) -> Outcome:
        """The cluster around a random start. alpha outside 0 to 1 counts as 0.5; an empty pool gives nothing."""
        alpha = alpha if 0 <= alpha <= 1 else 0.5
        rng = random.Random(seed) if seed else random.Random()
        start = roll_seed(self.graph, rng.random(), () if seed is not None else tuple(self.recent), alpha)
        nothing, no_results, no_hits = _empty(self.graph)
        if start is None:
            return Outcome(nothing, no_results, 0, no_hits, True)
        self.recent.append(start)
        anchors = self.graph.nodes.where(F.col("id") == start).select("id", "title", "type", F.lit(5).alias("level"), "deg")
        return Outcome(anchors, cluster(self.graph, anchors, options), 0, no_hits, True)

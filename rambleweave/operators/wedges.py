"""Pairs of nodes with neighbours in common, found in tasks that hold the whole graph as numbers.

Edges up to a checked number, and ids up to a checked size, are packed by one task into arrays and broadcast: nodes are
numbered in the order of their ids, so numbers break ties as ids do. A task then takes a range of nodes. No pair is
ever shuffled. For the best partners a neighbour of very many nodes, which makes most pairs, is not gone through:
nodes that share nothing else are alike but for their degree, so the first of a list are the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import shuffle_partitions
from .graph import LinkGraph

#: Edges and bytes of ids up to which a graph is broadcast: 8 bytes an edge and the ids make 128 MB at most.
KERNEL_EDGES, KERNEL_NAMES = 8_000_000, 64_000_000
#: Above this degree scores of neighbouring degrees might be equal once they are rounded to 12 digits.
KERNEL_DEGREE = 300_000
#: A neighbour of more nodes than this is heavy; only the heaviest are, as every set of them makes a list.
HEAVY_DEGREE, HEAVY = 500, 12
#: Pairs that a task holds at once (a single node may have more).
HELD = 1_000_000

PARTS = "starts binary, near binary, offsets binary, names binary, shown binary"


def fits(graph: LinkGraph, kernel_edges: int = KERNEL_EDGES) -> bool:
    """Whether the graph is one that tasks can hold."""
    if not 0 < graph.edge_count // 2 <= kernel_edges:
        return False
    most = graph.nodes.where("deg > 0").agg(F.max("deg").alias("deg"), F.sum(F.octet_length("id")).alias("names")).first()
    return most.deg <= KERNEL_DEGREE and most.names <= KERNEL_NAMES


def _key(c: str, salt: int) -> Column:
    """The number by which the packing task knows an id."""
    return F.xxhash64(c, F.lit(salt))


def _pack(rows: pa.Table) -> pa.Table:
    """One row of arrays from rows (null, a, b, null) of edges in one direction and rows (id, a, null, shown) of nodes, a and b keys of ids. If two nodes have one key, a row of nulls."""
    node = pc.is_valid(rows["id"])
    own, links = rows.filter(node).select(["id", "a", "shown"]), rows.filter(pc.invert(node)).select(["a", "b"])
    own = own.take(pc.sort_indices(own, [("id", "ascending")]))
    names, hashes = own["id"].cast(pa.string()).combine_chunks(), own["a"].to_numpy()
    place = np.argsort(hashes)
    ordered = hashes[place]
    if (ordered[1:] == ordered[:-1]).any():
        return pa.table({k: pa.nulls(1, pa.binary()) for k in ("starts", "near", "offsets", "names", "shown")})
    a, b = (place[np.searchsorted(ordered, links[c].to_numpy())] for c in ("a", "b"))
    n = len(names)
    keys = np.concatenate([a * n + b, b * n + a])
    keys.sort()
    starts = np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) * n).astype(np.int32)
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + n + 1]
    data = names.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]
    parts = {"starts": starts.tobytes(), "near": (keys % n).astype(np.int32).tobytes(), "offsets": (offsets - offsets[0]).tobytes(), "names": data, "shown": own["shown"].to_numpy().astype(np.uint8).tobytes()}
    return pa.table({k: pa.array([v], pa.binary()) for k, v in parts.items()})


def _packed(graph: LinkGraph) -> dict[str, bytes]:
    """The graph as arrays, made by one task from numbers for ids; with others if two ids should have the same."""
    salt = 0
    while True:
        none = lambda kind: F.lit(None).cast(kind)
        edges = graph.edges.where("src < dst").select(none("string").alias("id"), _key("src", salt).alias("a"), _key("dst", salt).alias("b"), none("boolean").alias("shown"))
        nodes = graph.nodes.where("deg > 0").select("id", _key("id", salt).alias("a"), none("long").alias("b"), F.coalesce(graph.presentable(), F.lit(False)).alias("shown"))
        # one row, whose size fits() has checked
        found = edges.unionByName(nodes).groupBy().applyInArrow(_pack, PARTS).first().asDict()
        if found["starts"] is not None:
            return {k: bytes(v) for k, v in found.items()}
        salt += 1


class Near:
    """A graph as arrays: the neighbours of node x, in order, are near[starts[x]:starts[x + 1]]."""

    def __init__(self, parts: dict[str, bytes], order: str):
        self.starts, self.near = np.frombuffer(parts["starts"], np.int32).astype(np.int64), np.frombuffer(parts["near"], np.int32)
        self.n = len(self.starts) - 1
        self.shown = np.frombuffer(parts["shown"], np.uint8) > 0
        self.names = pa.StringArray.from_buffers(self.n, pa.py_buffer(parts["offsets"]), pa.py_buffer(parts["names"]))
        self.degree = np.diff(self.starts)
        d = np.maximum(self.degree, 2)
        self.aa, self.ra = 1 / np.log(d), 1 / d
        most = np.argsort(-self.degree, kind="stable")[:HEAVY]
        self.heavies = np.sort(most[self.degree[most] > HEAVY_DEGREE])
        self.heavy = np.zeros(self.n, bool)
        self.heavy[self.heavies] = True
        self.mask = np.zeros(self.n, np.int64)
        for j, h in enumerate(self.heavies):
            self.mask[self.near[self.starts[h] : self.starts[h + 1]]] |= 1 << j
        # Nodes that may be shown by the set of heavy ones they refer to, the best first.
        listed = np.flatnonzero(self.shown & (self.mask > 0))
        listed = listed[np.lexsort((listed, *([self.degree[listed]] if order == "degree" else []), self.mask[listed]))]
        sets, first = np.unique(self.mask[listed], return_index=True)
        self.alike = dict(zip(sets.tolist(), np.split(listed, first[1:]))) if len(sets) else {}

    def around(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of nodes, one node after the other, and how many each has."""
        size = self.degree[nodes]
        end = np.cumsum(size)
        return self.near[np.repeat(self.starts[nodes] - (end - size), size) + np.arange(end[-1] if len(end) else 0)], size

    def chunks(self, nodes: np.ndarray, through: np.ndarray) -> Iterator[np.ndarray]:
        """Nodes in groups of about HELD pairs; through: the pairs each neighbour makes."""
        mids, size = self.around(nodes)
        total = np.concatenate([[0], np.cumsum(through[mids])])
        pairs = np.cumsum(total[np.cumsum(size)] - total[np.cumsum(size) - size] + size)
        yield from np.split(nodes, np.flatnonzero(np.diff(pairs // HELD)) + 1)

    def pairs(self, x: np.ndarray, light: bool, shown: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """keys (place in x times n, plus the partner) in order, where the neighbours of each begin, all neighbours, and keys of what is linked. light: not through heavy ones; shown: only partners that may be."""
        mids, size = self.around(x)
        own = np.repeat(np.arange(len(x), dtype=np.int64), size)
        linked = own * self.n + mids
        if light:
            keep = ~self.heavy[mids]
            mids, own = mids[keep], own[keep]
        y, size = self.around(mids)
        own, mids = np.repeat(own, size), np.repeat(mids, size)
        keep = x[own] != y
        if shown:
            keep &= self.shown[y]
        keys, mids = (own * self.n + y)[keep], mids[keep]
        order = np.argsort(keys, kind="stable")
        keys, mids = keys[order], mids[order]
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[begin], begin, mids, linked


def _within(keys: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(keys.shape, bool)
    return ordered[np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)] == keys


def _scores(g: Near, x: np.ndarray, keys: np.ndarray, aa: np.ndarray, ra: np.ndarray, n: np.ndarray, potential: bool) -> tuple[np.ndarray, np.ndarray]:
    """The score of each key from the sums over its light neighbours, and the set of heavy ones that both ends share."""
    own, y = x[keys // g.n], keys % g.n
    both = g.mask[own] & g.mask[y]
    hit = np.flatnonzero(both)
    if len(hit):
        aa, ra, n, met = aa.astype(float), ra.astype(float), n.astype(float), both[hit]
        for j, h in enumerate(g.heavies):
            at = hit[(met >> j) & 1 > 0]
            aa[at] += g.aa[h]
            ra[at] += g.ra[h]
            n[at] += 1
    # Sums differ in their last digits by the order of their terms; equal scores must stay equal.
    return np.round(aa + 0.5 * n / (g.degree[own] + g.degree[y] - n) + ra if potential else aa, 12), both


def _near_best(score: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Whether a score is one of the k greatest values of its node; nodes follow one another. So few are left to be sorted."""
    begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.append(begin, len(own)))
    least = np.maximum.reduceat(score, begin)
    for _ in range(k - 1):
        below = np.maximum.reduceat(np.where(score < np.repeat(least, size), score, -np.inf), begin)
        least = np.where(below > -np.inf, below, least)
    return score >= np.repeat(least, size)


def best_partners(g: Near, x: np.ndarray, k: int, potential: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of the nodes x its k best partners that may be shown and aren't linked to it: node, partner, score, number of shared neighbours, shared neighbours one after the other."""
    keys, begin, mids, linked = g.pairs(x, light=True, shown=True)
    end = np.append(begin[1:], len(mids))
    aa, ra = (np.add.reduceat(w[mids], begin) if len(begin) else np.zeros(0) for w in (g.aa, g.ra))
    apart = ~_within(keys, linked)
    # Partners that share heavy neighbours only: of each list the first k that are no others.
    mask, more = g.mask[x], []
    for own_set in np.unique(mask):
        for other, alike in g.alike.items():
            rows, many = np.flatnonzero(mask == own_set) if own_set & other else (), k + 8
            while len(rows):
                found = rows[:, None] * np.int64(g.n) + alike[None, :many]
                good = ~(_within(found, linked) | _within(found, keys) | (alike[None, :many] == x[rows][:, None]))
                place = np.cumsum(good, axis=1)
                done = (place[:, -1] >= k) | (many >= len(alike))
                more.append(found[done][(good & (place <= k))[done]])
                rows, many = rows[~done], many * 4
    extra = np.concatenate(more) if more else np.zeros(0, np.int64)
    part = np.flatnonzero(apart)
    keys, begin, end = keys[part], begin[part], end[part]
    score, both = _scores(g, x, keys, aa[part], ra[part], end - begin, potential)
    if len(keys):
        part = np.flatnonzero(_near_best(score, keys // g.n, k))
        keys, begin, end, score, both = keys[part], begin[part], end[part], score[part], both[part]
    none = np.zeros(len(extra))
    extra_score, extra_both = _scores(g, x, extra, none, none, none, potential)
    keys, score, both = np.concatenate([keys, extra]), np.concatenate([score, extra_score]), np.concatenate([both, extra_both])
    begin, end = np.concatenate([begin, none.astype(np.int64)]), np.concatenate([end, none.astype(np.int64)])
    own, y = keys // g.n, keys % g.n
    order = np.lexsort((y, -score, own))
    first = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    best = order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]
    size = (end - begin)[best]
    stop = np.cumsum(size)
    light = mids[np.repeat(begin[best] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
    of, shared = [np.repeat(np.arange(len(best)), size)], [light]
    for j, h in enumerate(g.heavies):
        at = np.flatnonzero((both[best] >> j) & 1)
        of.append(at)
        shared.append(np.full(len(at), h))
    of, shared = np.concatenate(of), np.concatenate(shared)
    return x[own[best]], y[best], score[best], np.bincount(of, minlength=len(best)), shared[np.lexsort((shared, of))]


def _named(g: Near, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, shared: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), g.names.take(pa.array(shared)))
    return pa.RecordBatch.from_pydict({"a": g.names.take(pa.array(a)), "b": g.names.take(pa.array(b)), **{c: pa.array(v) for c, v in more.items()}, "shared": lists})


def _over_nodes(graph: LinkGraph, order: str, schema: str, rows, only_shown: bool) -> DataFrame:  # noqa: ANN001
    """What rows(graph as arrays, nodes) makes of all nodes with edges, or of those that may be shown."""
    spark = graph.edges.sparkSession
    parts = _packed(graph)
    held = spark.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for batch in batches:
            g = g or Near(held.value, order)
            x = batch.column(0).to_numpy()
            yield from rows(g, x[g.shown[x]] if only_shown else x)

    return spark.range(0, len(parts["starts"]) // 4 - 1, 1, shuffle_partitions(spark)).mapInArrow(run, schema)


def best(graph: LinkGraph, k: int, potential: bool) -> DataFrame:
    """a, b, score, shared (sorted): the k best partners of each node, by Adamic-Adar; or, if potential, of each that may be shown, by all three scores."""

    def rows(g: Near, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in g.chunks(nodes, np.where(g.heavy, 0, g.degree)):
            if len(x):
                a, b, score, n, shared = best_partners(g, x, k, potential)
                yield _named(g, a, b, n, shared, score=score)

    return _over_nodes(graph, "degree" if potential else "id", "a string, b string, score double, shared array<string>", rows, potential)


def common(graph: LinkGraph) -> DataFrame:
    """a, b, aa, ra, n, shared (sorted): all pairs of a node that may be shown and another node with neighbours in common."""

    def rows(g: Near, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for x in g.chunks(nodes, g.degree):
            if not len(x):
                continue
            keys, begin, mids, _ = g.pairs(x, light=False, shown=False)
            if len(keys):
                n = np.diff(np.append(begin, len(mids)))
                yield _named(g, x[keys // g.n], keys % g.n, n, mids, aa=np.add.reduceat(g.aa[mids], begin), ra=np.add.reduceat(g.ra[mids], begin), n=n)

    return _over_nodes(graph, "id", "a string, b string, aa double, ra double, n long, shared array<string>", rows, True)

"""Leiden on arrays: a graph of millions of edges must fit one task."""

import random
import tracemalloc

import numpy as np

from rambleweave.operators import community


def test_level_is_small():
    """Under 40 bytes an edge for a graph, where dictionaries take over 150."""
    rng = np.random.default_rng(1)
    n, m = 10_000, 100_000
    a, b = rng.integers(0, n, m), rng.integers(0, n, m)
    tracemalloc.start()
    g = community._Level.of(np.concatenate([a, b]), np.concatenate([b, a]), None, np.zeros(n))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40 * m and sum(g.degree) == 2 * m


def test_equal_edges_add_up():
    g = community._Level.of(np.array([0, 1, 0, 1, 2]), np.array([1, 0, 1, 0, 0]), np.array([1.0, 1.0, 2.0, 2.0, 4.0]), np.array([0.5, 0.0, 0.0]))
    assert [list(g.around(v)) for v in range(3)] == [[(1, 3.0)], [(0, 3.0)], [(0, 4.0)]] and g.degree == [3.5, 3.0, 4.0]


def test_planted_communities():
    rng = random.Random(2)
    edges = sorted({(20 * k + i, 20 * k + j) for k in range(30) for i in range(20) for j in range(i) if rng.random() < 0.6} | {(20 * k, 20 * k + 21) for k in range(29)})
    found = community.leiden(edges, 600, 1.0, 1)
    assert sorted(map(len, ({i for i, c in enumerate(found) if c == x} for x in set(found)))) == [20] * 30

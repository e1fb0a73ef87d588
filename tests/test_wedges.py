"""Best partners and common neighbours in tasks that hold the graph: what joins find, also past neighbours of very many nodes."""

import random

import numpy as np
import pytest

from rambleweave.operators import similarity, wedges
from rambleweave.operators.graph import LinkGraph, documents


def refs(n, hubs, seed):
    rng = random.Random(seed)
    out = {f"n{i:03}": [f"n{rng.randrange(n):03}" for _ in range(rng.randrange(4))] for i in range(n)}
    for h in range(hubs):
        out[f"h{h}"] = [f"n{i:03}" for i in range(n) if rng.random() < 0.4]
    return out


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()), key=repr)


def test_kernel_finds_what_joins_find(spark):
    given = refs(120, 3, 1)
    g = LinkGraph(documents(spark.createDataFrame([(k, k if k != "n007" else "", v) for k, v in given.items()], "id string, title string, refs array<string>")))
    for find in (similarity.potential_links, lambda g, **k: similarity.similar_to(g, k=5, **k).drop("title", "type"), similarity.common_neighbours):
        assert rows(find(g)) == rows(find(g, kernel_edges=0)) != []


@pytest.mark.parametrize("potential", [True, False])
def test_heavy_neighbours_are_passed(monkeypatch, potential):
    """With lists of nodes that share heavy neighbours only, the result is the same as through all pairs."""
    given = refs(150, 4, 2)
    ids = sorted(given)
    number = {x: i for i, x in enumerate(ids)}
    keys = sorted({a * len(ids) + b for k, v in given.items() for x in v if x != k for a, b in ((number[k], number[x]), (number[x], number[k]))})
    near = np.array(keys) % len(ids)
    starts = np.searchsorted(np.array(keys), np.arange(len(ids) + 1) * len(ids)).astype(np.int32)
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * 4
    shown = np.array([i % 7 > 0 for i in range(len(ids))], np.uint8)
    parts = {"starts": starts.tobytes(), "near": near.astype(np.int32).tobytes(), "offsets": offsets.tobytes(), "names": "".join(x.ljust(4) for x in ids).encode(), "shown": shown.tobytes()}
    found = []
    for degree in (10_000, 40, 4):
        monkeypatch.setattr(wedges, "HEAVY_DEGREE", degree)
        g = wedges.Near(parts, "degree" if potential else "id")
        assert (len(g.heavies) > 0) == (degree < 10_000)
        found.append([x.tolist() for x in wedges.best_partners(g, np.arange(len(ids)), 3, potential)])
    assert found[0][0] and found[0] == found[1] == found[2]


def test_star_without_its_pairs(spark):
    """A star of n leaves has n * n pairs, of which each leaf needs the two best."""
    n = 20_000
    docs = spark.range(n).selectExpr("format_string('n%05d', id) AS id", "'t' AS title", "array('hub') AS refs").unionByName(spark.range(1).selectExpr("'hub' AS id", "'t' AS title", "array('x') AS refs"))
    got = similarity.potential_links(LinkGraph(documents(docs)))
    assert got.count() == 2 * n - 3
    assert got.where("a not in ('n00000', 'n00001')").count() == 0


def test_edges_without_an_order_of_references(spark):
    """All pairs by one shuffle and no window over references, from rows of documents put together once; a pair counts once, whichever end refers."""
    given = [("a", "A", ["b", "b", "c", "B", "a", "x"]), ("b", "B", ["a", "A"]), ("b", "B", ["a", "A"]), ("c", "", ["a", "C"])]
    g = LinkGraph(documents(spark.createDataFrame(given, "id string, title string, refs array<string>")))
    assert sorted(map(tuple, g.edges.collect())) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")] and g.ledger.where("kind = 'edge'").count() == 2
    assert "Window" not in g.edges._jdf.queryExecution().analyzed().toString() and g.nodes.count() == 3 and g._named.storageLevel.useMemory


def test_keys_of_ids_that_meet(spark, monkeypatch):
    """Two ids with one key would be one node; then other keys are taken."""
    g = LinkGraph(documents(spark.createDataFrame([(k, k, v) for k, v in refs(40, 1, 5).items()], "id string, title string, refs array<string>")))
    found, tried, key = rows(similarity.potential_links(g)), [], wedges._key
    monkeypatch.setattr(wedges, "_key", lambda c, salt: tried.append(salt) or (key(c, salt) if salt else key(c, salt) % 7))
    assert rows(similarity.potential_links(g)) == found != [] and set(tried) == {0, 1}


def test_near_best_keeps_ties():
    own = np.array([0, 0, 0, 0, 1, 2, 2, 2])
    score = np.array([1.0, 3.0, 2.0, 3.0, 5.0, 4.0, 4.0, 4.0])
    assert wedges._near_best(score, own, 1).tolist() == [False, True, False, True, True, True, True, True]
    assert wedges._near_best(score, own, 2).tolist() == [False, True, True, True, True, True, True, True]

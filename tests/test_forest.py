import random

import pytest

from rambleweave.operators.forest import descendants, hierarchy, subtree_sizes

SCHEMA = "id long, parent long, depth string, path string"


def brute(rows):
    up = {}
    for i, p in rows:
        if i is None:
            continue
        known = [x for x in (up.get(i), p) if x is not None]
        up[i] = min(known) if known else None
    out = {}
    for i in up:
        seen, x = [i], i
        while True:
            p = up[x]
            if p is None or p not in up:
                out[i] = (x, len(seen) - 1, "tree", tuple(reversed(seen)))
                break
            if p in seen:
                k = seen.index(p)
                out[i] = (min(seen[k:]), k, "below_cycle" if k else "cycle", None)
                break
            seen.append(p)
            x = p
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, p, "x", "y") for i, p in rows], SCHEMA)
    return {r.id: (r.root_id, r.depth, r.kind, tuple(r.path) if r.path is not None else None) for r in hierarchy(df, with_path=True, **options).collect()}


@pytest.mark.parametrize("seed,limits", [(1, (8, 6)), (2, (10, 40)), (3, (10**6, 10**6))])
def test_random_forests(spark, seed, limits):
    r = random.Random(seed)
    n = 120
    rows = [(i, r.choice([None, r.randrange(n + 10), r.randrange(n + 10), max(0, i - 1), i + 1])) for i in range(n)]
    rows += [(1000 + i, 1000 + (i + 1) % 20) for i in range(20)] + [(2000 + i, 1000 + i) for i in range(20)] + [(3000 + i, 3001 + i) for i in range(40)]
    rows += [(4000 + i, 4000) for i in range(1, 60)] + [(4000, None), (None, 3), (5000, 5000)] + rows[:15]
    r.shuffle(rows)
    assert run(spark, rows, fragment_rows=limits[0], solve_rows=limits[1]) == brute(rows)
    if seed == 1:
        assert run(spark, rows, one_task=10**6) == brute(rows)


def test_hot_parent_and_lost_parents(spark):
    rows = [(i, -1) for i in range(300)] + [(i, 5) for i in range(1000, 1200)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None), (None, 1)]) == {}


def test_several_parents_smallest_holds(spark):
    assert run(spark, [(1, None), (2, None), (3, 2), (3, 1), (3, None)])[3][:3] == (1, 1, "tree")


def test_descendants_and_sizes(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (9, 9)], "id long, parent long")
    placed = hierarchy(df, with_path=True)
    assert sorted(tuple(r) for r in descendants(placed).collect()) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]
    assert {r.id: (r.n_descendants, r.height) for r in subtree_sizes(df, hierarchy(df)).collect()} == {1: (3, 2), 2: (1, 1), 3: (0, 0), 4: (0, 0), 9: (0, 0)}


@pytest.mark.parametrize("seed,limits", [(1, (8, 6)), (2, (30, 20)), (3, (10**6, 10**6))])
def test_subtree_sizes(spark, seed, limits):
    r = random.Random(seed)
    rows = [(i, r.choice([i - 1, i - 1, r.randrange(i), None])) for i in range(1, 150)] + [(0, None)] + [(500 + i, 500) for i in range(1, 80)] + [(500, 777)]
    rows += rows[:9]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, parent long")
    up, want = dict(rows), {}
    for i in up:
        want.setdefault(i, [0, 0])
        x, k = up[i], 1
        while x in up:
            n, h = want.setdefault(x, [0, 0])
            want[x] = [n + 1, max(h, k)]
            x, k = up[x], k + 1
    got = {x.id: [x.n_descendants, x.height] for x in subtree_sizes(df, hierarchy(df), fragment_rows=limits[0], solve_rows=limits[1]).collect()}
    assert got == want

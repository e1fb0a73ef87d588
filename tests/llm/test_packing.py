import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from rambleweave.llm.packing import Packing, cross, evolve, first_solution, lower_bound, mutate, pack, pack_documents


def valid(p, sizes, capacity):
    assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
    assert all(sum(int(sizes[i]) for i in b) == capacity - r and r >= 0 for b, r in zip(p.bins, p.room))


def test_genetic_operators():
    rng = random.Random(1)
    sizes = np.sort(np.random.default_rng(2).integers(100, 900, 300))[::-1]
    s = sizes.tolist()
    a = first_solution(sizes, 1000)
    valid(a, sizes, 1000)
    b = mutate(a, s, 1000, rng)
    valid(b, sizes, 1000)
    for _ in range(20):
        a, b = b, cross(a, b, s, 1000, rng)
        valid(b, sizes, 1000)
    assert Packing.of(b.assigned(300), s, 1000).fitness(1000) == pytest.approx(b.fitness(1000))


def test_evolution_beats_best_fit():
    sizes = np.sort(np.random.default_rng(1).integers(300, 800, 1200))[::-1]
    first = len(first_solution(sizes, 2048).bins)
    best = evolve(sizes, 2048, [], random.Random(1), 25, 8)[0]
    valid(best, sizes, 2048)
    assert lower_bound(sizes, 2048) <= len(best.bins) < first


def rows_of(df):
    return [(r.doc_id, r.piece, r.start, r.size, r.bin) for r in df.collect()]


def check(rows, sizes, capacity):
    fill, pieces = Counter(), defaultdict(list)
    for d, p, start, size, b in rows:
        fill[b] += size
        pieces[d].append((p, start, size))
    assert max(fill.values(), default=0) <= capacity
    for d, n in sizes.items():
        at = 0
        for k, (p, start, size) in enumerate(sorted(pieces.pop(d))):
            assert (p, start) == (k, at)
            at += size
            assert n > capacity or size == n
        assert at == n
    assert not pieces
    return len(fill)


def test_pack(spark):
    r = random.Random(4)
    sizes = {i: r.choice([r.randrange(1, 400), r.randrange(300, 900), 2048, 5000, 2049]) for i in range(400)}
    rows = [(k, v, "x") for k, v in sizes.items()] + [(k, v, "x") for k, v in [*sizes.items()][:30]] + [(1001, 0, "x"), (1002, None, "x"), (None, 5, "x"), (1003, -4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, bin string")
    one = rows_of(pack(df, shard_items=60))
    n = check(one, sizes, 2048)
    assert n <= -(-sum(sizes.values()) // 2048) * 1.04 + 1
    assert sorted(one) == sorted(rows_of(pack(df, shard_items=60)))
    assert pack(df.limit(0)).count() == 0


def test_islands(spark):
    """Sizes for which best fit isn't enough, so that islands evolve and exchange."""
    r = np.random.default_rng(7)
    sizes = {i: int(v) for i, v in enumerate(r.integers(300, 800, 600))}
    df = spark.createDataFrame([*sizes.items()], "doc_id long, n_tokens int")
    n = check(rows_of(pack(df, islands=2, epochs=2, generations=10)), sizes, 2048)
    assert n < len(first_solution(np.sort(np.array([*sizes.values()]))[::-1], 2048).bins)


def test_documents(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 3000), (5, "a b c")], "doc_id long, text string")
    got = [(r.doc_id, r.piece, r.n_tokens) for r in pack_documents(df).collect()]
    assert {d for d, _, _ in got} == {1, 4, 5} and sum(n for d, _, n in got if d == 4) >= 3000

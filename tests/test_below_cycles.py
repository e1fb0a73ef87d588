import random

from rambleweave import queries


def test_below_and_on_cycles(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, (i + 1) % 7) for i in range(7)] + [(i, r.randrange(i)) for i in range(7, 60)] + [(100, 100), (101, 100), (200, None), (201, 200), (202, 201), (300, 999)]
    spark.createDataFrame(rows, "id long, parent long").write.parquet(f"{tmp_path}/block.parquet")
    up = dict(rows)
    want, paths = {}, {}
    for i in up:
        x, seen = up[i], [i]
        while x in up and x not in seen:
            seen.append(x)
            want[x, i] = len(seen) - 1
            x = up[x]
        cyclic = [x for x in seen if x < 7 or x == 100]
        paths[i] = "/".join(map(str, reversed(seen[: seen.index(cyclic[0]) + 1] if cyclic else seen)))
    got = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((x.id, x.descendant, x.distance) for x in got("p1_descendants")) == sorted((*k, d) for k, d in want.items())
    assert {x.id: x.path for x in got("p1_paths")} == paths
    below = {i: [d for (a, _), d in want.items() if a == i] for i in up}
    assert sorted((x.id, x.n_descendants, x.height) for x in got("p1_subtrees")) == sorted((i, len(d), max(d, default=0)) for i, d in below.items())

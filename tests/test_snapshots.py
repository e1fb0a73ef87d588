import random
from collections import Counter

import pytest

from rambleweave.operators.snapshots import FIELDS, change_counts, snapshot_changes

SCHEMA = "snap_no int, id string, title string, type string, path string, text string, tags array<string>, aliases array<string>, refs array<string>, kind string, size long"
BASE = {"title": "t", "type": "note", "path": "d/a.md", "text": "x", "tags": [], "aliases": [], "refs": []}


def row(snap, key, **given):
    v = BASE | given
    return (snap, key, *[v[f] for f in FIELDS], "clash", random.randrange(9))


def brute(rows):
    plain = lambda v: Counter(x or "" for x in v or []) if isinstance(v, (list, type(None))) and not isinstance(v, str) else v
    state: dict = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        own = {f: (r[2 + i] or "") if i < 4 else Counter(x or "" for x in r[2 + i] or []) for i, f in enumerate(FIELDS)}
        state.setdefault(r[0], {})[r[1]] = own
    out = []
    versions = sorted(state)
    for a, b in zip(versions, versions[1:]):
        old, new = state[a], state[b]
        gone, come = set(old) - set(new), set(new) - set(old)
        place = lambda d: (d["text"], d["path"].rpartition("/")[0])
        taken = set()
        for n in come:
            mates = [m for m in come if place(new[m]) == place(new[n])], [m for m in gone if place(old[m]) == place(new[n])]
            if len(mates[0]) == len(mates[1]) == 1:
                o = mates[1][0]
                if not (n.isascii() and n.isdigit() and o.isascii() and o.isdigit()):
                    out.append((b, n, "renamed", o))
                    taken |= {n, o}
        out += [(b, n, "added", "") for n in come - taken] + [(b, o, "deleted", "") for o in gone - taken]
        out += [(b, k, "updated", f) for k in set(old) & set(new) for f in FIELDS if old[k][f] != new[k][f]]
    del plain
    return sorted(out)


def run(spark, rows, **options):
    return sorted(tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), **options).collect())


def test_cases(spark):
    rows = [
        row(1, "same", tags=["a", None, "b"]), row(2, "same", tags=["b", "", "a"]), row(1, "nulls", title=None, refs=None), row(2, "nulls", title="", refs=[]),
        row(1, "twice", refs=["a", "a"]), row(2, "twice", refs=["a"]), row(1, "old", text="m", path="p/q/o.md"), row(2, "new", text="m", path="p/q/n.md"),
        row(1, "11", text="n", path="z"), row(2, "12", text="n", path="z"), row(1, "o1", text="w"), row(1, "o2", text="w"), row(2, "o3", text="w"),
        row(1, "moved", text="v", path="a/x"), row(2, "moved2", text="v", path="b/x"), row(2, None), row(None, "x"), row(5, "same", tags=["a", "b", ""], text="long " * 50_000),
    ]
    rows += rows[:6]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (2, "new", "renamed", "old") in got and (2, "twice", "updated", "refs") in got and not any(r[1] in ("same", "nulls") and r[0] == 2 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    r = random.Random(seed)
    pick = lambda: {"title": r.choice(["t", "", None, "u"]), "text": r.choice(["x", "y", "", None]), "path": r.choice(["a/b.md", "c.md", "a/d.md", None, ""]), "tags": r.choice([None, [], ["p"], ["p", "q"], ["q", "p"]])}
    rows = [row(s, str(k) if k % 3 else f"n{k}", **pick()) for s in (1, 2, 4) for k in r.sample(range(60), 40)]
    assert run(spark, rows + rows[:20], bucket_rows=7) == brute(rows)


def test_few_snapshots(spark):
    assert run(spark, []) == [] and run(spark, [row(3, "a")]) == []


def test_counts(spark):
    changes = snapshot_changes(spark.createDataFrame([row(1, "a"), row(2, "b", text="other")], SCHEMA))
    assert sorted(tuple(r) for r in change_counts(changes).collect()) == [(2, "added", 1), (2, "deleted", 1)]

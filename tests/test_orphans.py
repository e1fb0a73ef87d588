import random

import pytest

from rambleweave.operators.orphans import named_keys, orphans

REFS = "tbl string, scope string, period string, src_key string, target_key string, key string, n int"
KEYS = "tbl string, scope string, key string, period string"


def brute(refs, keys):
    there = {(t, s, k) for t, s, k in keys if k is not None}
    return sorted({(t, p or "none", a, b) for t, s, p, a, b in refs if b and (t, s, b) not in there}, key=repr)


def run(spark, refs, keys, heavy):
    r = spark.createDataFrame([(*x, "k", 1) for x in refs], REFS)
    k = spark.createDataFrame([(*x, "p") for x in keys], KEYS)
    return sorted((tuple(x) for x in orphans(r, k, heavy).collect()), key=repr)


@pytest.mark.parametrize("heavy", [1, 3, 10**9])
def test_against_brute_force(spark, heavy):
    r = random.Random(heavy)
    refs = [("a", r.choice("xy"), r.choice(["2024-01", "2024-02", None]), str(r.randrange(40)), r.choice(["hot", "gone", "gone", None, "", *map(str, range(30))])) for _ in range(400)]
    refs += refs[:50] + [("b", "", "none", None, "hot")]
    keys = [("a", "x", "hot"), ("a", "y", None), *[("a", "x", str(i)) for i in range(0, 30, 2)], ("a", "y", "3"), ("a", "y", "3")]
    assert run(spark, refs, keys, heavy) == brute(refs, keys)


def test_empty(spark):
    assert run(spark, [], [("a", "", "x")], 10) == []
    assert run(spark, [("a", "", "p", "s", "t")], [], 10) == [("a", "p", "s", "t")]


def test_names(spark):
    df = spark.createDataFrame([("i", None, ["a", None, "", "a"], 2), ("j", "", None, 3)], "id string, title string, aliases array<string>, snap_no int")
    assert sorted(tuple(r) for r in named_keys("t", df, "snap_no").collect()) == [("t", "2", "a"), ("t", "2", "i"), ("t", "3", "j")]

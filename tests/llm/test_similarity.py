import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rambleweave.llm import grams as G
from rambleweave.llm.neardup import group_pairs, near_duplicates
from rambleweave.llm.sets import clean_tags, link_counts, set_pairs, set_signatures, sets_of, similar_between, similar_within


def brute_groups(rows, least=200):
    texts = {}
    for i, title, text in rows:
        c = re.sub("[ \t\r\n]+", " ", ((title or "") + " " + (text or "")).lower()).strip(" ")
        if i is not None and len(c) >= least:
            texts.setdefault(i, set()).add(c)
    sets = {(i, c): {c[k : k + 5] for k in range(len(c) - 4)} for i, cs in texts.items() for c in cs}
    up = {i: i for i in texts}
    find = lambda x: x if up[x] == x else find(up[x])
    for (a, x), (b, y) in combinations(sets.items(), 2):
        if 10 * len(x & y) >= 7 * len(x | y):
            up[find(a[0])] = find(b[0])
    return {(a, b) for a, b in combinations(sorted(texts), 2) if find(a) == find(b)}


def vary(r, text, n):
    words = text.split(" ")
    for _ in range(n):
        k = r.randrange(len(words))
        r.choice([lambda: words.__setitem__(k, "new" + str(r.randrange(99))), lambda: words.insert(k, "extra"), lambda: words.insert(r.randrange(len(words)), words.pop(k))])()
    return " ".join(words)


def test_near_duplicates(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 10))) for _ in range(250)] + ["字句文章", "λόγος"]
    rows = []
    for k in range(60):
        text = " ".join(r.choice(vocabulary) for _ in range(r.choice([25, 60, 120, 400])))
        rows.append((f"d{k}", "Title", text))
        rows += [(f"d{k}v{j}", r.choice(["Title", None]), vary(r, text, r.randrange(0, 25))) for j in range(r.choice([0, 1, 3]))]
    rows += [("copy1", "T", rows[0][2]), ("copy2", "T", rows[0][2] + " \n"), ("null1", None, None), ("null2", None, None), ("short", "a", "b"), (None, "T", rows[0][2]), ("same", "aaaa", "a" * 500), ("same2", "aaaa", "a" * 700), ("long", "", "x y z " * 20_000)]
    rows += rows[:20]
    df = spark.createDataFrame([(*x, "clash", 0) for x in rows], "id string, title string, text string, content string, d long")
    got = {(x.id_a, x.id_b) for x in group_pairs(near_duplicates(df)).collect()}
    assert got == brute_groups(rows) and len(got) > 50
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.6, 0.7, 0.8, 0.95])
@pytest.mark.parametrize("seed", range(2))
def test_signatures_lose_nothing(seed, threshold):
    """Sets at the very threshold share as many signatures as are asked for, whatever the frequencies."""
    r = np.random.default_rng(seed)
    table = G.quantised(r.choice([2, 15, 20, 300, 1400, 2000, 5000], 1 << 20))
    new = lambda n: r.integers(0, 1 << G.GRAM_BITS, n).astype(np.uint64)
    tried = 0
    for _ in range(60):
        x = np.unique(new(int(r.integers(1, 700))))
        both = int(np.ceil(len(x) * r.uniform(threshold, 1.0)))
        # y: of all sizes that reach the threshold
        most = int(np.floor(both / threshold)) - len(x)
        y = np.unique(np.concatenate([r.permutation(x)[:both], new(int(r.integers(0, max(most, 0) + 1)))]))
        inter = len(np.intersect1d(x, y))
        if inter < threshold * (len(x) + len(y) - inter):
            continue
        tried += 1
        small, large = sorted((x, y), key=len)
        p = G.signatures(np.concatenate([small, large]), np.repeat([0, 1], [len(small), len(large)]), 2, table, threshold)
        of_small, of_large = (p.of == 0) & (p.reach >= len(large)), (p.of == 1) & (p.reach >= len(small)) & ~p.visitor
        shared = len(set(p.sig[of_small].tolist()) & set(p.sig[of_large].tolist()))
        assert shared >= G.shared_needed(G.size_class(len(large)), threshold)
    assert tried > 10


def test_refused_threshold():
    with pytest.raises(ValueError):
        G.signatures(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.zeros(16, np.uint8), 0.3)


def test_hot_signatures(spark):
    """Many similar texts and look-alikes, with every signature of more than a few texts hot: met in blocks, the groups are the same."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 10))) for _ in range(120)]
    form = " ".join(r.choice(words) for _ in range(40))
    rows = [(f"f{k}", "Form", form + " " + " ".join(r.choice(words) for _ in range(r.choice([4, 18, 40])))) for k in range(60)]
    rows += [(f"v{k}", "Form", vary(r, form, 6)) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, title string, text string")
    got = {(x.id_a, x.id_b) for x in group_pairs(near_duplicates(df, hot=5)).collect()}
    assert got == brute_groups(rows) and len(got) > 100


def brute_sets(rows, threshold, least):
    sets = {(i, frozenset(v for v in vs or [] if v)) for i, vs in rows if i is not None}
    sets = [s for s in sets if len(s[1]) >= least]
    return {tuple(sorted((a[0], b[0]))) for a, b in combinations(sets, 2) if a[0] != b[0] and len(a[1] & b[1]) * 1000 >= threshold * 1000 * len(a[1] | b[1])}


def test_similar_sets(spark):
    r = random.Random(2)
    values = [f"v{i}" for i in range(40)] + ["hot"] * 15 + [None, ""]
    rows = []
    for k in range(80):
        base = [r.choice(values) for _ in range(r.choice([2, 4, 6, 9, 20]))]
        rows.append((f"n{k}", base))
        rows += [(f"n{k}m{j}", [v for v in base if r.random() < 0.9] + r.sample(values, r.randrange(3))) for j in range(r.randrange(3))]
    rows += [("null", None), ("empty", []), (None, ["v1", "v2", "v3", "v4"]), *[(f"copy{i}", ["v1", "v2", "v3", "v4"]) for i in range(6)], ("big", [f"b{i}" for i in range(3000)]), ("big2", [f"b{i}" for i in range(2900)])]
    rows += rows[:30]
    big = [f"w{i}" for i in range(300)]
    for k in range(25):
        base = r.sample(big, r.choice([25, 31, 33, 60, 200])) + ["hot"]
        rows += [(f"large{k}", base), (f"large{k}m", [v for v in base if r.random() < 0.85] + ["hot", "x"])]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "id string, refs array<string>, members string, d int")
    expected = brute_sets(rows, 0.6, 4)
    assert {(x.id_a, x.id_b) for x in similar_within(df, "id", F.col("refs")).collect()} == expected and len(expected) > 30
    sets, _ = sets_of(df, "id", F.col("refs"), 4)
    usual, blocks = ({tuple(x) for x in set_pairs(sets, hot=h).collect()} for h in (4096, 3))
    assert usual == blocks and len(usual) > 30
    links = {x.id: x.links for x in link_counts(df, "id", F.col("refs")).collect()}
    assert all(links[i] == sum(i in p for p in expected) for i in links)
    assert similar_within(df.limit(0), "id", F.col("refs")).count() == 0


def test_similar_between(spark):
    left = spark.createDataFrame([("a", ["#X", " y", "Z ", "x"]), ("b", ["x"]), ("c", None), ("d", ["x", "y", "q", "z", "w"])], "id string, tags array<string>")
    right = spark.createDataFrame([("s", ["x", "Y", "z", None]), ("t", ["##x", "y", "z"]), ("u", [])], "id string, tags array<string>")
    got = {tuple(r) for r in similar_between(left, right, "id", clean_tags(F.col("tags")), clean_tags(F.col("tags"))).collect()}
    assert got == {("a", "s"), ("d", "s")}
    a, b = (sets_of(x, "id", clean_tags(F.col("tags")), 3)[0] for x in (left, right))
    assert {tuple(x) for x in set_pairs(a, b, hot=1).collect()} == {tuple(x) for x in set_pairs(a, b).collect()} != set()
    assert similar_between(left, right.limit(0), "id", F.col("tags"), F.col("tags")).count() == 0


def test_set_signatures_meet():
    r = np.random.default_rng(3)
    table = G.quantised(r.choice([1, 3, 50, 4000], 1 << 20))
    for _ in range(300):
        n = int(r.integers(1, 40))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([r.permutation(x)[: int(np.ceil(0.8 * n))], r.integers(0, 2**63, int(r.integers(0, 6))).astype(np.uint64)]))
        inter = len(np.intersect1d(x, y))
        if inter >= 0.6 * (len(x) + len(y) - inter):
            small, large = sorted((x, y), key=len)
            assert np.isin(set_signatures(small, table, 10_000, 0.6, False), set_signatures(large, table, 10_000, 0.6, True)).any()

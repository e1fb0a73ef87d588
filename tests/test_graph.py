"""Fixtures with values worked out by hand."""

import pytest

from rambleweave.operators import community, relation, similarity
from rambleweave.operators.activation import activate, levels, pagerank
from rambleweave.operators.anchors import resolve, resolve_id, text_search
from rambleweave.operators.graph import LinkGraph, documents
from rambleweave.operators.reconcile import redirected
from rambleweave.operators.roaming import RandomWalks, RoamOptions, interleaved, quota_plan, roam, roll_pool, roll_seed
from rambleweave.schema import DOCUMENTS


def docs(spark, *rows):
    """(id, title, type, refs[, aliases, tags, text])"""
    out = []
    for r in rows:
        i, title, kind, refs, *rest = r
        aliases, tags, text = [*rest, [], [], ""][:3] if len(rest) < 3 else rest
        out.append((i, title, aliases or [], kind, f"{i}.md", None, None, refs, tags or [], text or ""))
    return spark.createDataFrame(out, DOCUMENTS)


def same(spark, refs, kind="note"):
    return docs(spark, *[(k, k, kind, v) for k, v in refs.items()])


@pytest.fixture(scope="module")
def f2(spark):
    rows = [("A", "A", "人物", ["X", "Y"]), ("B", "B", "人物", ["X", "Y"]), ("C", "C", "人物", ["X"]), ("D", "D", "人物", ["A"]), ("X", "X", "设定", ["A", "B", "C"]), ("Y", "Y", "设定", ["A", "B"]), ("hub", "hub", "目录", ["X"])]
    return LinkGraph(docs(spark, *rows), ("目录",))


@pytest.fixture(scope="module")
def f3(spark):
    rows = [("a", "Alpha", "note", ["b", "c"]), ("b", "Beta", "note", ["c", "d"]), ("c", "Gamma", "note", ["e"]), ("d", "Delta", "note", []), ("e", "Epsilon", "note", ["a"]), ("s1", "目录", "toc", ["a"]), ("s2", "", "note", ["a"]), ("s3", "孤立", "note", [])]
    return LinkGraph(docs(spark, *rows), ("toc",))


@pytest.mark.parametrize(
    "rows,edges",
    [
        ([("a", "", "", ["周真"]), ("人物_012", "周真", "", [])], {("a", "人物_012")}),
        ([("a", "", "", ["周真"]), ("人物_012", "周玄", "", [], ["周真"])], {("a", "人物_012")}),
        ([("a", "", "", ["周真"]), ("人物_012", "周真", "", []), ("周真", "", "", [])], {("a", "周真")}),
        ([("人物_012", "周真", "", ["周真"])], set()),
        ([("a", "", "", ["n"]), ("z", "n", "", []), ("m", "n", "", []), ("b", "q", "", [], ["n"])], {("a", "m")}),
    ],
)
def test_redirects(spark, rows, edges):
    g = LinkGraph(docs(spark, *rows))
    assert {(r.src, r.dst) for r in g.edges.collect()} == edges | {(b, a) for a, b in edges}
    assert g.dangling().count() == 0


def test_dangling(spark):
    g = LinkGraph(same(spark, {"a": ["ghost1", "b", "ghost2"], "b": ["ghost1"]}))
    assert sorted(tuple(r) for r in g.dangling().collect()) == [("a", "ghost1"), ("a", "ghost2"), ("b", "ghost1")]
    s = g.stats().first()
    assert (s.dangling_kinds, s.dangling_links) == (2, 3)


def test_stats(f2, f3):
    s = f2.stats().first()
    assert (s.nodes, s.total_links, s.multi_edge, s.edges, s.orphans, s.components, s.self_links) == (7, 12, 5, 7, 0, 1, 0)
    assert s.top_hubs == "X|A|B|Y|C|D|hub"
    assert f2.hub_degree == 3
    s = f3.stats().first()
    assert (s.nodes, s.total_links, s.edges, s.orphans, s.components) == (8, 8, 8, 1, 2)


def test_similar(f2):
    got = {r.id: r.score for r in similarity.similar(f2, "A").collect()}
    assert got == pytest.approx({"B": 2.164043, "C": 0.721348}, abs=1e-6)
    assert similarity.similar(f2, "none").count() == 0
    links = {(r.a, r.b): (round(r.score, 6), r.shared) for r in similarity.potential_links(f2).collect()}
    assert links[("D", "Y")] == (1.493573, ["A"]) and links[("B", "C")] == (1.221348, ["X"])


def test_suggestions(spark):
    g = LinkGraph(same(spark, {"A": ["X", "Y"], "B": ["X", "Y"], "C": ["X"], "X": ["A", "B", "C"], "Y": ["A", "B"], "D": [], "E": [], "F": []}))
    got = {(r.a, r.b): round(r.score, 6) for r in similarity.potential_links(g).collect()}
    assert got == {("X", "Y"): 4.218723, ("A", "B"): 3.686268, ("A", "C"): 1.493573, ("B", "C"): 1.493573}
    g = LinkGraph(same(spark, {"A": ["B"], "B": ["A", "C"], "C": ["B"], "D": [], "E": []}))
    r = similarity.suggest_links(g).collect()
    assert [(x.a, x.b, x.shared, x.algorithms, round(x.score, 6)) for x in r] == [("A", "C", ["B"], ["aa", "jaccard", "ra"], 2.442695)]
    star = LinkGraph(same(spark, {"H": ["L1", "L2", "L3", "L4"], **{f"L{i}": ["H"] for i in range(1, 5)}, **{f"p{i}": [] for i in range(6)}}))
    got = {(r.a, r.b): round(r.score, 6) for r in similarity.potential_links(star).collect()}
    assert got == dict.fromkeys([("L1", "L2"), ("L1", "L3"), ("L1", "L4"), ("L2", "L3"), ("L2", "L4")], 1.471348)


def results(outcome):
    return [(r.id, round(r.score, 6), round(r.ppr, 6), r.hops) for r in outcome.results.orderBy("pos").collect()]


def test_roam(f3):
    out = roam(f3, "Alpha", RoamOptions(top=10))
    assert [r.id for r in out.anchors.collect()] == ["a"] and out.fallback == 0
    assert results(out) == [("c", 0.75, 0.158423, 1), ("d", 0.5, 0.042196, 2), ("b", 0.697399, 0.148929, 1), ("e", 0.498685, 0.113062, 1), ("s2", 0.25, 0.068175, 1)]
    assert [r[:3] for r in results(roam(f3, "Delta", RoamOptions(top=10)))] == [("b", 0.5, 0.269248), ("c", 0.5, 0.144838), ("e", 0.75, 0.076904), ("s2", 0.25, 0.035867)]


def test_roam_fallbacks(spark, f3):
    assert roam(f3, "  ").fallback == 0 and roam(f3, " ").anchors.count() == 0
    g = LinkGraph(docs(spark, ("7", "Seven", "note", [], [], [], "x"), ("b", "B", "note", [], [], [], "seven Seven"), ("c", "C", "toc", [], [], [], "seven"), *[(f"p{i}", "", "note", []) for i in range(6)]), ("toc",))
    out = roam(g, "even S")
    assert out.fallback == 1 and [(r.id, r["count"]) for r in out.hits.collect()] == [("b", 1)]
    out = roam(g, "7")
    assert out.fallback == 2 and [(r.id, r["count"]) for r in out.hits.collect()] == [("b", 2)]


def test_two_tiers_agree(spark, f3):
    seeds = spark.createDataFrame([("a",), ("s3",), ("a",), ("nobody",)], "id string")
    one = {r.id: r.ppr for r in pagerank(f3, seeds).collect()}
    two = {r.id: r.ppr for r in pagerank(f3, seeds, kernel_edges=0).collect()}
    assert one == pytest.approx(two, abs=1e-12)
    assert one["s3"] == pytest.approx(0.15 / 2)  # an isolated seed keeps its share of teleport, nothing else


def test_activation(spark, f3):
    assert levels(0.7, 0.1, 5) == [1.0, 0.7, 0.7 * 0.7, 0.7 * 0.7 * 0.7, 0.7 * 0.7 * 0.7 * 0.7, 0.7 * 0.7 * 0.7 * 0.7 * 0.7]
    assert levels(0.5, 0.5, 5) == [1.0, 0.5] and levels(0.7, 2.0, 3) == [1.0]
    got = {r.id: (r.hops, r.path) for r in activate(f3, spark.createDataFrame([("d",)], "id string")).collect()}
    assert got == {"d": (0, ["d"]), "b": (1, ["d", "b"]), "a": (2, ["d", "b", "a"]), "c": (2, ["d", "b", "c"]), "e": (3, ["d", "b", "a", "e"]), "s1": (3, ["d", "b", "a", "s1"]), "s2": (3, ["d", "b", "a", "s2"])}


@pytest.mark.parametrize(
    "n,have,plan,order",
    [
        (15, [99, 99, 99], [8, 5, 2], "123123121121121"), (10, [99, 99, 99], [5, 3, 2], "1231231211"), (10, [99, 0, 0], [5, 3, 2], "11111"), (15, [99, 0, 0], [8, 5, 2], "1" * 8),
        (15, [3, 2, 99], [8, 4, 3], "12312313"), (4, [2, 2, 0], [2, 1, 1], "121"), (3, [9, 9, 9], [2, 1, 0], "121"),
    ],
)
def test_quota(n, have, plan, order):
    if (n, have) not in ((15, [3, 2, 99]),):
        assert quota_plan(n, have) == plan
    assert "".join(str(b) for b, _ in interleaved(n, have)) == order


def test_random_walks(f3):
    assert {r.id for r in roll_pool(f3).collect()} == {"b", "c", "d", "e"}
    picks = {roll_seed(f3, u / 20) for u in range(20)}
    assert picks == {"b", "c", "d", "e"}
    assert roll_seed(f3, 0.3, ["a", "b", "c", "d"]) == "e" and roll_seed(f3, 0.5, ["b", "c", "d", "e"]) is None
    one, two = RandomWalks(f3).roam(seed=7), RandomWalks(f3).roam(seed=7)
    assert one.random and one.anchors.first().id == two.anchors.first().id and results(one) == results(two)
    assert one.anchors.first().id not in [r[0] for r in results(one)]


def test_relation(spark):
    g = LinkGraph(same(spark, {"a": ["b", "c"], "b": ["a", "c", "e"], "c": ["a", "b", "e"], "e": ["c", "b"]}))
    r = relation.relation(g, "a", "b").first()
    assert (r.hops, r.direct, round(r.activation, 9)) == (1, True, 0.7)
    assert (r.ppr_there, r.ppr_back, r.affinity) == pytest.approx((0.271276596, 0.180851064, 0.226063830), abs=1e-8)
    r = relation.relation(g, "a", "e").first()
    assert r.hops == 2 and r.activation == pytest.approx(0.49) and r.path == ["a", "b", "e"] and r.ppr_there == pytest.approx(0.153723404, abs=1e-8)
    assert [(x.a, x.b, x.witnesses) for x in relation.evidence(g, r.path).orderBy("pos").collect()] == [("a", "b", ["a", "b"]), ("b", "e", ["b", "e"])]
    assert relation.relation(g, "a", "a").first().hops == 0 and relation.relation(g, "a", "zz").count() == 0
    g = LinkGraph(same(spark, {"a": ["b"], "b": ["a"], "x": [], "y": ["x"]}))
    r = relation.relation(g, "a", "x").first()
    assert (r.hops, r.activation, r.path) == (-1, -1.0, [])


def test_node_detail(spark):
    g = LinkGraph(docs(spark, ("n", "N", "note", [], ["al"], ["t"], "字" * 250), ("m", "M", "note", ["n"]), ("k", "A", "note", ["N"])))
    r = relation.node_detail(g, "n").first()
    assert (r.text_len, r.truncated, len(r.summary), r.deg) == (250, True, 201, 2)
    assert [x.id for x in r.neighbours] == ["k", "m"] and [x.id for x in r.backlinks] == ["m"]
    assert relation.node_detail(g, "m").first().truncated is False and relation.node_detail(g, "zz").count() == 0


@pytest.mark.parametrize("limit", [10**6, 0])
def test_communities(spark, limit):
    clique = lambda c: {f"{c}{i}": [f"{c}{j}" for j in range(1, 5) if j != i] for i in range(1, 5)}
    refs = {**clique("A"), **clique("B"), "orphan": []}
    refs["A4"] = refs["A4"] + ["B1"]
    got = community.communities(LinkGraph(same(spark, refs)), seed=42, kernel_edges=limit)
    member = {r.id: r.community for r in got.membership.collect()}
    assert "orphan" not in member and len(member) == 8 and got.modularity.first().modularity > 0
    if limit:
        assert member["A1"] != member["B1"] and len(set(member.values())) == 2
        assert community.trimmed(got, node="A2").first().nodes == ["A1", "A2", "A3", "A4"]
    assert community.communities(LinkGraph(same(spark, {"a": [], "b": []}))).membership.count() == 0


def test_resolve(spark):
    d = docs(spark, ("q", "x", "", []), ("b", "q", "", []), ("c", "", "", [], ["q"]), ("d", "", "", [], [], ["q"]), ("eqe", "", "", []), ("f", "", "", []))
    assert {r.id: r.level for r in resolve(d, " q ").collect()} == {"q": 5, "b": 4, "c": 3, "d": 2, "eqe": 1}
    assert resolve_id(d, "q") == "q" and resolve_id(d, "nothing") is None
    assert resolve(d, "").count() == 6 and text_search(d, "", 5).count() == 0


def test_documents(spark):
    df = spark.createDataFrame([("a", None, ["x", None, ""], "extra"), ("a", None, ["x", None, ""], "extra"), (None, "t", None, "e"), ("b", "t", None, "e")], "id string, title string, refs array<string>, kind string")
    got = {r.id: (r.title, r.refs, r.tags, r.text) for r in documents(df).collect()}
    assert got == {"a": ("", ["x"], [], ""), "b": ("t", [], [], "")}
    empty = LinkGraph(documents(df.limit(0)))
    assert empty.stats().first().nodes == 0 and empty.hot().count() == 0 and roam(empty, "x").fallback == 1


def test_renames_lead_references(spark):
    d = same(spark, {"a": ["old", "old", "x"], "b": ["y", "y"], "new": []})
    ren = spark.createDataFrame([("old", "mid"), ("mid", "new"), ("p", "q"), ("q", "p")], "old_id string, new_id string")
    assert {r.id: r.refs for r in redirected(d, ren).collect()} == {"a": ["new", "x"], "b": ["y", "y"], "new": []}
    assert {(r.src, r.dst) for r in LinkGraph(d, (), ren).edges.collect()} == {("a", "new"), ("new", "a")}

"""The link graph over notes and shared notes: every graph operator as a query, with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_numeric, note_uri, path_similarity, summary, title_or_id
from ..operators import community, relation, similarity
from ..operators.activation import activate, pagerank
from ..operators.anchors import decorate, resolve, text_search
from ..operators.components import components
from ..operators.graph import LinkGraph, documents, name_index
from ..operators.reconcile import final_names, redirected
from ..operators.roaming import RandomWalks, RoamOptions, cluster, roam, roll_pool, roll_seed
from .common import Query, table

#: What the queries ask for. The shared inbox is by far the most referred to; tags and parts of names give many anchors.
STRUCTURAL = ("目录",)
ANCHOR, WORD, START, END = "harbor", "window", "shared_inbox", "shared_sinijugifi"

#: Numbers by which random starts are drawn.
STARTS = [0.013, 0.42, 0.639, 0.97]


def graph(spark: SparkSession, sf: str) -> LinkGraph:
    both = table(spark, sf, "notes").unionByName(table(spark, sf, "shared_note"))
    return LinkGraph(documents(both), STRUCTURAL)


def _joined(c: str, name: str | None = None) -> Column:
    return F.array_join(c, "|").alias(name or c)


def g1_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).ledger


def g1_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).edges


def g2_names(spark: SparkSession, sf: str) -> DataFrame:
    return name_index(graph(spark, sf).docs)


def _renames(docs: DataFrame) -> DataFrame:
    """For tests: every alias is an old id of its note; of several notes the greatest id holds."""
    return docs.select(F.explode("aliases").alias("old_id"), F.col("id").alias("new_id")).where("old_id <> new_id").groupBy("old_id").agg(F.max("new_id").alias("new_id"))


def g3_final_names(spark: SparkSession, sf: str) -> DataFrame:
    return final_names(_renames(graph(spark, sf).docs))


def g3_redirected(spark: SparkSession, sf: str) -> DataFrame:
    docs = graph(spark, sf).docs
    return redirected(docs, _renames(docs)).select("id", _joined("refs"))


def g4_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).dangling()


def g5_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).stats()


def g6_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).component_of()


def g7_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).nodes


def g7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).neighbours(START)


def g8_anchors(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return decorate(resolve(g.docs, ANCHOR), g.nodes)


def g10_search(spark: SparkSession, sf: str) -> DataFrame:
    return text_search(graph(spark, sf).docs, WORD, 30)


def g11_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return pagerank(g, resolve(g.docs, ANCHOR)).select("id", F.round("ppr", 12).alias("ppr"))


def g11_pagerank_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    """The rounds as joins, as for a graph that is too large for one task."""
    g = graph(spark, sf)
    return pagerank(g, resolve(g.docs, ANCHOR), kernel_edges=0).select("id", F.round("ppr", 12).alias("ppr"))


def g12_activation(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return activate(g, resolve(g.docs, ANCHOR)).select("id", F.round("act", 9).alias("act"), "hops", F.array_join("path", ">").alias("path"))


def _results(df: DataFrame) -> DataFrame:
    return df.select("pos", "id", "title", "type", F.round("score", 6).alias("score"), F.round("ppr", 9).alias("ppr"), F.round("act", 9).alias("act"), "hops", F.array_join("path", ">").alias("path"))


def g13_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 best around one node."""
    g = graph(spark, sf)
    return _results(cluster(g, g.nodes.where(F.col("id") == END).select("id"), RoamOptions(top=60)))


def g15_roam(spark: SparkSession, sf: str) -> DataFrame:
    return _results(roam(graph(spark, sf), ANCHOR).results)


def g15_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A query that names nothing finds texts."""
    found = roam(graph(spark, sf), "next to the window")
    return found.hits.select("id", "title", "type", "count", F.lit(found.fallback).alias("fallback"))


def g16_random(spark: SparkSession, sf: str) -> DataFrame:
    return _results(RandomWalks(graph(spark, sf)).roam(seed=42).results)


def g17_pool(spark: SparkSession, sf: str) -> DataFrame:
    return roll_pool(graph(spark, sf)).select("id", F.round("w", 9).alias("w"))


def g20_common(spark: SparkSession, sf: str) -> DataFrame:
    """Common neighbours of all pairs of nodes that may be presented."""
    found = similarity.common_neighbours(graph(spark, sf))
    return found.select("a", "b", F.round("aa", 6).alias("aa"), F.round("ra", 6).alias("ra"), "n", _joined("shared"))


def g21_similar(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar(graph(spark, sf), END, 10).select("id", "title", "type", F.round("score", 6).alias("score"), _joined("shared"))


def g21_similar_all(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar nodes of every node."""
    return similarity.similar_to(graph(spark, sf), k=5).select("key", "id", F.round("score", 6).alias("score"), _joined("shared"))


def g22_potential(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.potential_links(graph(spark, sf)).select("a", "b", F.round("score", 6).alias("score"), _joined("algorithms"), _joined("shared"))


def g23_suggest(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.suggest_links(graph(spark, sf), 50).select("a", "a_title", "b", "b_title", F.round("score", 6).alias("score"))


def g24_path(spark: SparkSession, sf: str) -> DataFrame:
    path = relation.shortest_path(graph(spark, sf), START, END)
    return spark.createDataFrame([(START, END, ">".join(path or []), len(path) - 1 if path else -1)], "start string, end string, path string, hops int")


def g25_relation(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda c: F.round(c, 12).alias(c)
    return relation.relation(graph(spark, sf), START, END).select("start", "end", "hops", "direct", F.round("activation", 9).alias("activation"), r("ppr_there"), r("ppr_back"), r("affinity"), F.array_join("path", ">").alias("path"))


def g26_evidence(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf)
    return relation.evidence(g, relation.shortest_path(g, START, END) or []).select("pos", "a", "b", _joined("witnesses"))


def g27_node(spark: SparkSession, sf: str) -> DataFrame:
    names = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), "|").alias(c)
    return relation.node_detail(graph(spark, sf), START).select("id", "title", "type", "path", _joined("aliases"), _joined("tags"), "summary", "text_len", "truncated", "deg", names("neighbours"), names("backlinks"))


def g28_communities(spark: SparkSession, sf: str) -> DataFrame:
    return community.communities(graph(spark, sf)).communities


def g28_check(spark: SparkSession, sf: str) -> DataFrame:
    """What communities promise: linked nodes, how many of them are in none or in several, how many communities are not connected by themselves, and whether types make a better partition."""
    g = graph(spark, sf)
    found = community.communities(g)
    linked = g.nodes.where("deg > 0").select("id")
    held = linked.join(found.membership.groupBy("id").count(), "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.coalesce("count", F.lit(0)) != 1).alias("unheld"))
    side = lambda c: found.membership.select(F.col("id").alias(c), F.col("community").alias(f"{c}_in"))
    inside = g.edges.join(side("src"), "src").join(side("dst"), "dst").where("src_in = dst_in")
    parts = found.membership.join(components(inside, "src", "dst"), "id", "left").select("community", F.coalesce("component", "id").alias("part")).distinct()
    split = parts.groupBy("community").count().where("count > 1").agg(F.count("*").alias("split"))
    q = lambda df, name: df.withColumnRenamed("modularity", name)
    types = community.modularity(g, linked.join(g.nodes.select("id", F.col("type").alias("community")), "id"))
    tables = [held, split, q(found.modularity, "own"), q(types, "types")]
    one = tables[0]
    for t in tables[1:]:  # tables of one row each
        one = one.unionByName(t, allowMissingColumns=True)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    return one.select("nodes", "unheld", "split", (F.col("types") > F.col("own")).alias("types_better"))


def g29_check(spark: SparkSession, sf: str) -> DataFrame:
    """What trimming promises: the ten largest communities in order, with sizes that are those of their lists and at most eight titles."""
    t = g29_trimmed(spark, sf)
    before = F.lag("size").over(Window.orderBy("community"))  # ten rows
    return t.withColumn("rises", F.coalesce(F.col("size") > before, F.lit(False))).agg(
        F.max("community").alias("last"), F.count_if("rises").alias("rising"), F.count_if(F.size("nodes") != F.col("size")).alias("wrong"), F.count_if(F.size("top_titles") != F.least(F.col("size"), F.lit(8))).alias("titles")
    ).select((F.col("last") < 10).alias("at_most_ten"), "rising", "wrong", "titles")


def g16_starts(spark: SparkSession, sf: str) -> DataFrame:
    """The starts that some numbers of [0, 1) pick from the pool."""
    g = graph(spark, sf)
    return spark.createDataFrame([(u, roll_seed(g, u)) for u in STARTS], "u double, id string")


def g28_modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Of the partition by type, whose value SQL can tell."""
    g = graph(spark, sf)
    return community.modularity(g, g.nodes.where("deg > 0").select("id", F.col("type").alias("community"))).select(F.round("modularity", 9).alias("modularity"))


def g29_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return community.trimmed(community.communities(graph(spark, sf)), 10)


def g30_hot(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).hot(20)


def g31_types(spark: SparkSession, sf: str) -> DataFrame:
    return graph(spark, sf).types()


def x_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar functions over all notes."""
    d = graph(spark, sf).docs
    return d.select("id", title_or_id(F.col("title"), F.col("id")).alias("name"), summary(F.col("text")).alias("summary"), is_numeric(F.col("id")).alias("numeric"), note_uri(F.col("path"), F.col("id"), "my vault").alias("uri"), F.round(path_similarity(F.col("path"), F.concat("path", F.lit("x"))), 9).alias("likeness"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        g1_ledger, g1_edges, g2_names, g3_final_names, g3_redirected, g4_dangling, g5_stats, g6_components, g7_degrees, g7_neighbours, g8_anchors, g10_search, g11_pagerank, g11_pagerank_by_joins,
        g12_activation, g13_ranked, g15_roam, g15_fallback, g16_random, g16_starts, g17_pool, g20_common, g21_similar, g21_similar_all, g22_potential, g23_suggest, g24_path, g25_relation, g26_evidence, g27_node,
        g28_communities, g28_check, g28_modularity, g29_trimmed, g29_check, g30_hot, g31_types, x_texts,
    )
}

_LIST = "[x FOR x IN coalesce({0}, []) IF x <> ''] AS {0}"
_GRAPH = f"""d AS (SELECT DISTINCT id, coalesce(title, '') AS title, coalesce(type, '') AS type, coalesce(path, '') AS path, coalesce(text, '') AS text, {", ".join(_LIST.format(c) for c in ("aliases", "refs", "tags"))}
 FROM (SELECT * FROM notes UNION ALL SELECT * FROM shared_note) WHERE id IS NOT NULL),
named AS (SELECT id AS target, 0 AS rank, id AS name FROM d UNION ALL SELECT id, 1, title FROM d UNION ALL SELECT id, 2, unnest(aliases) FROM d),
names AS (SELECT name, first(target ORDER BY rank, target) AS target FROM named WHERE name <> '' GROUP BY name),
l0 AS (SELECT id AS src, CAST(generate_subscripts(refs, 1) - 1 AS INTEGER) AS pos, unnest(refs) AS ref FROM d),
l1 AS (SELECT src, pos, ref, target, CASE WHEN ref = src THEN 'self' WHEN target IS NULL THEN 'dangling' WHEN target = src THEN 'redirect_self' END AS k FROM l0 LEFT JOIN names ON ref = name),
ledger AS (SELECT src, pos, ref, target, coalesce(k, CASE WHEN row_number() OVER (PARTITION BY k, least(src, target), greatest(src, target) ORDER BY src, pos) = 1 THEN 'edge' ELSE 'multi' END) AS kind FROM l1),
edges AS MATERIALIZED (SELECT src, target AS dst FROM ledger WHERE kind = 'edge' UNION ALL SELECT target, src FROM ledger WHERE kind = 'edge'),
nodes AS MATERIALIZED (SELECT id, title, type, CAST(coalesce(n, 0) AS INTEGER) AS deg FROM d LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) ON id = src),
size AS (SELECT count(*) AS n FROM nodes),
shown AS (SELECT id, title, type, deg FROM nodes WHERE title <> '' AND deg > 0 AND deg < (SELECT n // 2 FROM size) AND type <> '目录')"""

_ANCHORS = """anchors AS (SELECT id, CASE WHEN id = '{q}' THEN 5 WHEN title = '{q}' THEN 4 WHEN list_contains(aliases, '{q}') THEN 3 WHEN list_contains(tags, '{q}') THEN 2 ELSE 1 END AS level
 FROM d WHERE id = '{q}' OR title = '{q}' OR list_contains(aliases, '{q}') OR list_contains(tags, '{q}') OR contains(id, '{q}') OR contains(title, '{q}'))"""

_PPR = """w AS (SELECT nodes.id, nodes.deg, coalesce(1.0 / (SELECT count(*) FROM seeds) * s.one, 0.0) AS w FROM nodes LEFT JOIN (SELECT id, 1 AS one FROM seeds) s USING (id)),
p(i, id, p) AS (SELECT 0, id, CAST(1.0 AS DOUBLE) / (SELECT n FROM size) FROM nodes WHERE deg > 0
 UNION ALL SELECT max(p.i) + 1, w.id, 0.85 * sum(p.p / x.deg) + 0.15 * max(w.w) FROM p JOIN nodes x ON x.id = p.id JOIN edges ON edges.src = p.id JOIN w ON w.id = edges.dst WHERE p.i < 60 GROUP BY w.id),
ppr AS (SELECT w.id, coalesce(p.p, 0.15 * w.w) AS ppr FROM w LEFT JOIN p ON p.id = w.id AND p.i = 60)"""

_ACT = """h0 AS (SELECT nodes.id, id AS path, 0 AS hops FROM nodes SEMI JOIN seeds USING (id)),
h1 AS (SELECT dst AS id, min(path || '>' || dst) AS path, 1 AS hops FROM h0 JOIN edges ON src = id WHERE dst NOT IN (SELECT id FROM h0) GROUP BY dst),
h2 AS (SELECT dst AS id, min(path || '>' || dst) AS path, 2 AS hops FROM h1 JOIN edges ON src = id WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1) GROUP BY dst),
h3 AS (SELECT dst AS id, min(path || '>' || dst) AS path, 3 AS hops FROM h2 JOIN edges ON src = id WHERE dst NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1 UNION SELECT id FROM h2) GROUP BY dst),
act AS (SELECT id, path, hops, CAST([1.0, 0.7, 0.7 * 0.7, 0.7 * 0.7 * 0.7][hops + 1] AS DOUBLE) AS act FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3))"""

#: The plan of the quota is by hand for buckets that have enough rows; what they lack, the result lacks.
_RANK = """cand AS (SELECT a.*, ppr, least(greatest(hops, 1), 3) AS bucket FROM act a JOIN ppr USING (id) WHERE id NOT IN (SELECT id FROM seeds) AND id NOT IN (SELECT id FROM nodes WHERE type = '目录' OR deg >= (SELECT n // 2 FROM size))),
scored AS (SELECT *, CAST(0.5 * CASE WHEN max(ppr) OVER b > min(ppr) OVER b THEN (ppr - min(ppr) OVER b) / (max(ppr) OVER b - min(ppr) OVER b) ELSE 0.5 END
 + 0.5 * CASE WHEN max(act) OVER b > min(act) OVER b THEN (act - min(act) OVER b) / (max(act) OVER b - min(act) OVER b) ELSE 0.5 END AS DOUBLE) AS score FROM cand WINDOW b AS (PARTITION BY bucket)),
placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS rn FROM scored),
have AS (SELECT count(*) FILTER (bucket = 1) AS n1, count(*) FILTER (bucket = 2) AS n2, count(*) FILTER (bucket = 3) AS n3 FROM cand),
turns(i, t1, t2, t3, b, rn) AS (SELECT -1, 0, 0, 0, 0, 0 FROM have
 UNION ALL SELECT i + 1, t1 + (nb = 1)::INT, t2 + (nb = 2)::INT, t3 + (nb = 3)::INT, nb, CASE nb WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END + 1
 FROM (SELECT t.*, (SELECT x FROM unnest([(i + 1) % 3 + 1, (i + 2) % 3 + 1, (i + 3) % 3 + 1]) WITH ORDINALITY u(x, o)
   WHERE CASE x WHEN 1 THEN t1 < least({q1}, n1) WHEN 2 THEN t2 < least({q2}, n2) ELSE t3 < least({q3}, n3) END ORDER BY o LIMIT 1) AS nb FROM turns t, have WHERE i + 1 < {n}) WHERE nb IS NOT NULL),
ranked AS (SELECT CAST(i AS INTEGER) AS pos, id, title, type, round(score, 6) AS score, round(ppr, 9) AS ppr, round(act, 9) AS act, hops, path FROM turns JOIN placed ON placed.bucket = turns.b AND placed.rn = turns.rn JOIN nodes USING (id) WHERE i >= 0)"""

_COMMON = """common AS (SELECT x.dst AS a, y.dst AS b, sum(1 / ln(greatest(deg, 2))) AS aa, sum(1 / greatest(deg, 2)) AS ra, count(*) AS n, array_to_string(list_sort(list(x.src)), '|') AS shared
 FROM edges x JOIN edges y ON x.src = y.src AND x.dst <> y.dst JOIN nodes ON nodes.id = x.src WHERE x.dst IN (SELECT id FROM {left}) GROUP BY x.dst, y.dst)"""

_POTENTIAL = """pot AS (SELECT c.a, c.b, round(aa + 0.5 * c.n / (x.deg + y.deg - c.n) + ra, 12) AS score, shared FROM common c JOIN shown x ON x.id = c.a JOIN shown y ON y.id = c.b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = c.a AND e.dst = c.b)),
best AS (SELECT * FROM pot QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 2),
links AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score, max(shared) AS shared FROM best GROUP BY ALL)"""

_SEARCH = "SELECT id, title, type, CAST((length(low) - length(replace(low, '{q}', ''))) / length('{q}') AS INTEGER) AS count FROM (SELECT *, lower(text) AS low FROM d) WHERE contains(low, '{q}') ORDER BY count DESC, id LIMIT {n}"

_PATH = f"""bfs(id, path, depth) AS (SELECT '{START}', '{START}', 0 UNION ALL SELECT dst, min(path || '>' || dst), max(depth) + 1 FROM bfs JOIN edges ON src = id WHERE depth < 6 AND id <> '{END}' GROUP BY dst),
way AS (SELECT depth, path FROM bfs WHERE id = '{END}' ORDER BY depth, path LIMIT 1)"""


def _ppr_of(seed: str, name: str) -> str:
    return _PPR.replace("(SELECT count(*) FROM seeds)", "1").replace("FROM seeds", f"FROM (SELECT '{seed}' AS id)").replace("ppr AS (", f"{name} AS (", 1).replace("w AS (SELECT nodes", f"w_{name} AS (SELECT nodes", 1).replace("JOIN w ON", f"JOIN w_{name} w ON").replace("FROM w LEFT", f"FROM w_{name} w LEFT").replace("p(i, id, p)", f"p_{name}(i, id, p)").replace("FROM p JOIN", f"FROM p_{name} p JOIN").replace("JOIN p ON", f"JOIN p_{name} p ON")


_SEEDS = f"{_ANCHORS.format(q=ANCHOR)}, seeds AS (SELECT id FROM anchors)"
_RENAMES = "ren AS (SELECT old_id, max(new_id) AS new_id FROM (SELECT unnest(aliases) AS old_id, id AS new_id FROM d) WHERE old_id <> new_id GROUP BY old_id)"
_FINAL = "chase(old_id, new_id, n) AS (SELECT old_id, new_id, 0 FROM ren UNION ALL SELECT c.old_id, r.new_id, n + 1 FROM chase c JOIN ren r ON c.new_id = r.old_id WHERE n < 50), fin AS (SELECT old_id, new_id FROM chase WHERE new_id NOT IN (SELECT old_id FROM ren))"

SQL: dict[str, str] = {
    "g1_ledger": f"WITH {_GRAPH} SELECT * FROM ledger",
    "g1_edges": f"WITH {_GRAPH} SELECT * FROM edges",
    "g2_names": f"WITH {_GRAPH} SELECT * FROM names",
    "g3_final_names": f"WITH RECURSIVE {_GRAPH}, {_RENAMES}, {_FINAL} SELECT * FROM fin",
    "g3_redirected": f"""WITH RECURSIVE {_GRAPH}, {_RENAMES}, {_FINAL}, moved AS (SELECT src, pos, ref, new_id FROM l0 LEFT JOIN fin ON ref = old_id),
 led AS (SELECT src, min(pos) AS pos, coalesce(new_id, ref) AS ref FROM moved WHERE src IN (SELECT src FROM moved WHERE new_id IS NOT NULL) GROUP BY src, coalesce(new_id, ref)
  UNION ALL SELECT src, pos, ref FROM moved WHERE src NOT IN (SELECT src FROM moved WHERE new_id IS NOT NULL))
 SELECT id, coalesce(string_agg(ref, '|' ORDER BY pos), '') AS refs FROM d LEFT JOIN led ON src = id GROUP BY id""",
    "g4_dangling": f"WITH {_GRAPH} SELECT src AS source, ref AS target FROM ledger WHERE kind = 'dangling'",
    "g5_stats": f"""WITH RECURSIVE {_GRAPH}, reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT reach.a, dst FROM reach JOIN edges ON b = src)
 SELECT (SELECT n FROM size) AS nodes, (SELECT CAST(count(*) / 2 AS BIGINT) FROM edges) AS edges, (SELECT count(*) FROM nodes WHERE deg = 0) AS orphans, count(*) AS total_links, count(*) FILTER (kind = 'self') AS self_links, count(*) FILTER (kind = 'multi') AS multi_edge,
 count(DISTINCT ref) FILTER (kind = 'dangling') AS dangling_kinds, count(*) FILTER (kind = 'dangling') AS dangling_links,
 (SELECT count(DISTINCT c) FROM (SELECT id, coalesce(min(b), id) AS c FROM nodes LEFT JOIN reach ON a = id GROUP BY id)) AS components,
 (SELECT string_agg(id, '|' ORDER BY deg DESC, id) FROM (SELECT id, deg FROM nodes WHERE deg > 0 ORDER BY deg DESC, id LIMIT 10)) AS top_hubs FROM ledger""",
    "g6_components": f"WITH RECURSIVE {_GRAPH}, reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT reach.a, dst FROM reach JOIN edges ON b = src) SELECT id, coalesce(min(b), id) AS component FROM nodes LEFT JOIN reach ON a = id GROUP BY id",
    "g7_degrees": f"WITH {_GRAPH} SELECT * FROM nodes",
    "g7_neighbours": f"WITH {_GRAPH} SELECT nodes.* FROM edges JOIN nodes ON dst = id WHERE src = '{START}'",
    "g8_anchors": f"WITH {_GRAPH}, {_ANCHORS.format(q=ANCHOR)} SELECT id, title, type, level, deg FROM anchors JOIN nodes USING (id)",
    "g10_search": f"WITH {_GRAPH} {_SEARCH.format(q=WORD, n=30)}",
    "g11_pagerank": f"WITH RECURSIVE {_GRAPH}, {_SEEDS}, {_PPR} SELECT id, round(ppr, 12) AS ppr FROM ppr",
    "g11_pagerank_by_joins": f"WITH RECURSIVE {_GRAPH}, {_SEEDS}, {_PPR} SELECT id, round(ppr, 12) AS ppr FROM ppr",
    "g12_activation": f"WITH {_GRAPH}, {_SEEDS}, {_ACT} SELECT id, round(act, 9) AS act, hops, path FROM act",
    "g13_ranked": f"WITH RECURSIVE {_GRAPH}, seeds AS (SELECT '{END}' AS id), {_PPR}, {_ACT}, {_RANK.format(q1=30, q2=18, q3=12, n=60)} SELECT * FROM ranked",
    "g15_roam": f"WITH RECURSIVE {_GRAPH}, {_SEEDS}, {_PPR}, {_ACT}, {_RANK.format(q1=8, q2=5, q3=2, n=15)} SELECT * FROM ranked",
    "g15_fallback": f"WITH {_GRAPH} SELECT *, 1 AS fallback FROM ({_SEARCH.format(q='next to the window', n=30)})",
    "g17_pool": f"WITH {_GRAPH} SELECT id, round(pow(deg, 0.5), 9) AS w FROM shown",
    "g20_common": f"WITH {_GRAPH}, {_COMMON.format(left='shown')} SELECT a, b, round(aa, 6) AS aa, round(ra, 6) AS ra, n, shared FROM common",
    "g21_similar": f"""WITH {_GRAPH}, {_COMMON.format(left=f"(SELECT '{END}' AS id)")} SELECT id, title, type, round(aa, 6) AS score, shared FROM common JOIN shown ON id = b WHERE b NOT IN (SELECT dst FROM edges WHERE src = '{END}') ORDER BY aa DESC, id LIMIT 10""",
    "g21_similar_all": f"""WITH {_GRAPH}, {_COMMON.format(left="nodes")}, r AS (SELECT a, b, aa, shared, row_number() OVER (PARTITION BY a ORDER BY round(aa, 12) DESC, b) AS rn FROM common JOIN shown ON id = b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = a AND e.dst = b))
 SELECT a AS key, b AS id, round(aa, 6) AS score, shared FROM r WHERE rn <= 5""",
    "g22_potential": f"WITH {_GRAPH}, {_COMMON.format(left='shown')}, {_POTENTIAL} SELECT a, b, round(score, 6) AS score, 'aa|jaccard|ra' AS algorithms, shared FROM links",
    "g23_suggest": f"WITH {_GRAPH}, {_COMMON.format(left='shown')}, {_POTENTIAL}, top AS (SELECT * FROM links ORDER BY score DESC, a, b LIMIT 50) SELECT a, x.title AS a_title, b, y.title AS b_title, round(score, 6) AS score FROM top JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b",
    "g24_path": f"""WITH RECURSIVE {_GRAPH}, {_PATH} SELECT '{START}' AS start, '{END}' AS "end", path, CAST(depth AS INTEGER) AS hops FROM way""",
    "g25_relation": f"""WITH RECURSIVE {_GRAPH}, {_PATH}, {_ppr_of(START, "there")}, {_ppr_of(END, "back")}
 SELECT '{START}' AS start, '{END}' AS "end", CAST(depth AS INTEGER) AS hops, depth = 1 AS direct, round(pow(0.7, depth), 9) AS activation, round(t.ppr, 12) AS ppr_there, round(b.ppr, 12) AS ppr_back, round((t.ppr + b.ppr) / 2, 12) AS affinity, path
 FROM way, there t, back b WHERE t.id = '{END}' AND b.id = '{START}'""",
    "g26_evidence": f"""WITH RECURSIVE {_GRAPH}, {_PATH}, p AS (SELECT string_split(path, '>') AS p FROM way), s AS (SELECT CAST(i - 1 AS INTEGER) AS pos, p[i] AS a, p[i + 1] AS b FROM p, unnest(range(1, len(p))) u(i)),
 said AS (SELECT pos, CASE WHEN d.title = '' THEN d.id ELSE d.title END AS t FROM s JOIN d ON (d.id = a AND list_contains(refs, b)) OR (d.id = b AND list_contains(refs, a)))
 SELECT s.pos, a, b, coalesce((SELECT array_to_string(list_sort(list(DISTINCT t))[1:3], '|') FROM said WHERE said.pos = s.pos), '') AS witnesses FROM s""",
    "g27_node": f"""WITH {_GRAPH} SELECT d.id, d.title, d.type, path, array_to_string(aliases, '|') AS aliases, array_to_string(tags, '|') AS tags, CASE WHEN length(text) > 200 THEN text[1:200] || '…' ELSE text END AS summary, CAST(length(text) AS INTEGER) AS text_len, length(text) > 200 AS truncated, deg,
 (SELECT string_agg(n.id, '|' ORDER BY n.title, n.id) FROM edges JOIN nodes n ON n.id = dst WHERE src = '{START}') AS neighbours, (SELECT string_agg(id, '|' ORDER BY title, id) FROM d WHERE list_contains(refs, '{START}')) AS backlinks
 FROM d JOIN nodes USING (id) WHERE d.id = '{START}'""",
    "g28_check": f"WITH {_GRAPH} SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS unheld, CAST(0 AS BIGINT) AS split, false AS types_better FROM nodes WHERE deg > 0",
    "g29_check": "SELECT true AS at_most_ten, CAST(0 AS BIGINT) AS rising, CAST(0 AS BIGINT) AS wrong, CAST(0 AS BIGINT) AS titles",
    "g16_starts": f"""WITH {_GRAPH}, pool AS (SELECT id, pow(deg, 0.5) AS w FROM shown), run AS (SELECT id, sum(w) OVER (ORDER BY id) AS run, sum(w) OVER () AS total FROM pool), u AS (SELECT unnest({STARTS}) AS u) SELECT CAST(u AS DOUBLE) AS u, (SELECT min(id) FROM run WHERE run >= u * total) AS id FROM u""",
    "g28_modularity": f"""WITH {_GRAPH}, e AS (SELECT x.type AS c, y.type AS k FROM edges JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst), m AS (SELECT count(*) AS m FROM e)
 SELECT round(sum(i / m - pow(n / m, 2)), 9) AS modularity FROM (SELECT c, count(*) AS n, count(*) FILTER (c = k) AS i FROM e GROUP BY c), m""",
    "g30_hot": f"WITH {_GRAPH} SELECT * FROM nodes WHERE deg < (SELECT n // 2 FROM size) AND type <> '目录' ORDER BY deg DESC, id LIMIT 20",
    "g31_types": f"WITH {_GRAPH} SELECT type, count(*) AS n FROM nodes GROUP BY type",
    "x_texts": f"""WITH {_GRAPH} SELECT id, CASE WHEN title = '' THEN id ELSE title END AS name, CASE WHEN length(text) > 200 THEN text[1:200] || '…' ELSE text END AS summary, regexp_full_match(id, '[0-9]+') AS "numeric",
 CASE WHEN path = '' THEN '' ELSE 'obsidian://open?vault=my+vault&file=' || replace(replace(url_encode(regexp_replace(path, '\\.md$', '')), '%20', '+'), '~', '%7E') END AS uri,
 round(0.9 + 0.1 * strlen(string_split(path, '/')[-1]) / (strlen(string_split(path, '/')[-1]) + 1), 9) AS likeness FROM d""",
}

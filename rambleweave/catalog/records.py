"""Hierarchies, orphan references and snapshot changes over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import utc
from ..operators.forest import around_cycles, cycle_places, cycle_sizes, descendants, hierarchy, subtree_sizes
from ..operators.orphans import named_keys, orphan_counts, orphans, union_all
from ..operators.snapshots import FIELDS, change_counts, snapshot_changes
from ..plans.durable import cut
from .common import Query, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy(table(spark, sf, "block"))


def _everything(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All blocks with paths, also below cycles, and the places of those on cycles."""
    block = table(spark, sf, "block")
    placed = cut(hierarchy(block, with_path=True, below_cycles=True))
    return placed, cut(cycle_places(block, placed))


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The path of every block: below a cycle from the cycle's node, on a cycle the block alone."""
    placed = hierarchy(table(spark, sf, "block"), with_path=True, below_cycles=True)
    return placed.select("id", "root_id", "depth", "kind", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    placed, places = _everything(spark, sf)
    return descendants(placed).unionByName(around_cycles(placed, places))


def p1_subtrees(spark: SparkSession, sf: str) -> DataFrame:
    block = table(spark, sf, "block")
    placed = cut(hierarchy(block))
    sizes, places = cut(subtree_sizes(block, placed)), cut(cycle_places(block, placed))
    return sizes.join(places, "id", "left_anti").unionByName(cycle_sizes(sizes, places))


def references(spark: SparkSession, sf: str) -> DataFrame:
    """All references of the tables: tbl, scope, period, src_key, target_key."""
    notes, snaps, touch = (table(spark, sf, t) for t in ("notes", "note_snap", "touch"))
    block, ref = table(spark, sf, "block"), table(spark, sf, "block_ref")
    month = lambda c: F.date_format(utc(F.col(c)), "yyyy-MM")
    row = lambda tbl, scope, period, src, target: [F.lit(tbl).alias("tbl"), scope.alias("scope"), period.alias("period"), src.cast("string").alias("src_key"), target.cast("string").alias("target_key")]
    none = F.lit("")
    exploded = lambda df: df.withColumn("ref", F.explode("refs"))
    when = block.groupBy("id").agg(F.max("modified").alias("modified"))
    # when has each id once, so a block that refers very often is split by the adaptive skew join.
    dated = ref.where("f is not null and t is not null").join(when, ref["f"] == when["id"], "left")
    return union_all(
        [
            exploded(notes.select("id", "mtime", "refs")).select(*row("notes", none, F.date_format("mtime", "yyyy-MM"), F.col("id"), F.col("ref"))),
            exploded(snaps.select("snap_no", "snap_at", "id", "refs")).select(*row("note_snap", F.col("snap_no").cast("string"), F.date_format("snap_at", "yyyy-MM-dd"), F.col("id"), F.col("ref"))),
            touch.select(*row("touch", none, month("ts"), F.col("seq"), F.col("target"))),
            block.select(*row("block", none, month("modified"), F.col("id"), F.col("parent"))),
            dated.select(*row("block_ref", none, month("modified"), F.col("f"), F.col("t"))),
        ]
    )


def existing(spark: SparkSession, sf: str) -> DataFrame:
    """The keys that may be referred to: tbl, scope, key."""
    notes, snaps, shared = (table(spark, sf, t).select("id", "title", "aliases", *(["snap_no"] if t == "note_snap" else [])) for t in ("notes", "note_snap", "shared_note"))
    block = table(spark, sf, "block")
    ids = lambda tbl, df: df.select(F.lit(tbl).alias("tbl"), F.lit("").alias("scope"), F.col("id").cast("string").alias("key"))
    return union_all(
        [
            named_keys("notes", notes), named_keys("notes", shared), named_keys("note_snap", snaps, "snap_no"), named_keys("note_snap", shared, None),
            ids("touch", notes), ids("touch", shared), ids("block", block), ids("block_ref", block),
        ]
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(references(spark, sf), existing(spark, sf))


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table and period."""
    return orphan_counts(references(spark, sf), existing(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "note_snap"))


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    return change_counts(p5_found(spark, sf))


QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_paths, p1_descendants, p1_subtrees, p4_found, p4_counts, p5_found, p5_counts)}

_TREE = """b AS (SELECT DISTINCT id, parent FROM block WHERE id IS NOT NULL),
up AS (SELECT x.id, x.parent AS above FROM b x JOIN b y ON x.parent = y.id),
reach(id, anc) AS (SELECT id, above FROM up UNION SELECT r.id, u.above FROM reach r JOIN up u ON r.anc = u.id),
on_cycle AS (SELECT id FROM reach WHERE id = anc),
low AS (SELECT c.id, min(r.anc) AS root_id FROM on_cycle c JOIN reach r USING (id) GROUP BY c.id),
rooted AS (SELECT id FROM b ANTI JOIN up USING (id)),
found AS (
SELECT b.id, b.id AS root_id, 0 AS depth, 'tree' AS kind FROM b JOIN rooted USING (id)
UNION ALL SELECT id, root_id, 0, 'cycle' FROM low
UNION ALL SELECT r.id, min(l.root_id), CAST(1 + (SELECT count(*) FROM reach q WHERE q.id = r.id AND q.anc NOT IN (SELECT id FROM on_cycle)) AS INTEGER), 'below_cycle'
  FROM reach r JOIN low l ON r.anc = l.id WHERE r.id NOT IN (SELECT id FROM on_cycle) GROUP BY r.id
UNION ALL SELECT r.id, min(CASE WHEN k.id IS NOT NULL THEN r.anc END), CAST(count(*) AS INTEGER), 'tree'
  FROM reach r LEFT JOIN rooted k ON r.anc = k.id WHERE r.id NOT IN (SELECT q.id FROM reach q JOIN on_cycle c ON q.anc = c.id) GROUP BY r.id)"""

_WALK = _TREE + """, walk(id, anc, k, seen) AS (SELECT id, above, 1, [id, above] FROM up WHERE above <> id
 UNION ALL SELECT w.id, u.above, k + 1, list_append(seen, u.above) FROM walk w JOIN up u ON w.anc = u.id WHERE NOT list_contains(seen, u.above))"""

_ORPHANS = """n AS (SELECT DISTINCT * FROM notes), s AS (SELECT DISTINCT * FROM note_snap),
names AS (SELECT id AS k FROM shared_note UNION SELECT title FROM shared_note UNION SELECT unnest(aliases) FROM shared_note),
nk AS (SELECT id AS k FROM n UNION SELECT title FROM n UNION SELECT unnest(aliases) FROM n UNION SELECT k FROM names),
sk AS (SELECT snap_no, id AS k FROM s UNION SELECT snap_no, title FROM s UNION SELECT snap_no, unnest(aliases) FROM s UNION SELECT snap_no, k FROM names CROSS JOIN (SELECT DISTINCT snap_no FROM s)),
tk AS (SELECT id AS k FROM n UNION SELECT id FROM shared_note),
blk AS (SELECT DISTINCT id, modified, parent FROM block),
found AS (
SELECT 'notes' AS tbl, coalesce(strftime(mtime, '%Y-%m'), 'none') AS period, id AS src_key, r AS target_key FROM (SELECT id, mtime, unnest(refs) AS r FROM n) WHERE r <> '' AND NOT EXISTS (SELECT 1 FROM nk WHERE nk.k = r)
UNION SELECT 'note_snap', strftime(snap_at, '%Y-%m-%d'), id, r FROM (SELECT snap_no, snap_at, id, unnest(refs) AS r FROM s) x WHERE r <> '' AND NOT EXISTS (SELECT 1 FROM sk WHERE sk.k = r AND sk.snap_no = x.snap_no)
UNION SELECT 'touch', strftime(make_timestamp(ts * 1000000), '%Y-%m'), CAST(seq AS VARCHAR), target FROM touch WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.k = target)
UNION SELECT 'block', coalesce(strftime(make_timestamp(modified * 1000000), '%Y-%m'), 'none'), CAST(id AS VARCHAR), CAST(parent AS VARCHAR) FROM blk x WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blk y WHERE y.id = x.parent)
UNION SELECT 'block_ref', coalesce(strftime(make_timestamp(y.modified * 1000000), '%Y-%m'), 'none'), CAST(f AS VARCHAR), CAST(t AS VARCHAR) FROM block_ref x LEFT JOIN blk y ON x.f = y.id WHERE t IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blk z WHERE z.id = x.t))"""

_STR = ("title", "type", "path", "text")
_LIST = ("tags", "aliases", "refs")
_CHANGES = f"""s AS (SELECT DISTINCT snap_no, id, {", ".join(f"coalesce({c}, '') AS {c}" for c in _STR)},
 {", ".join(f"list_sort([coalesce(x, '') FOR x IN coalesce({c}, [])]) AS {c}" for c in _LIST)},
 CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM note_snap WHERE id IS NOT NULL),
v AS (SELECT snap_no AS now, lag(snap_no) OVER (ORDER BY snap_no) AS was FROM (SELECT DISTINCT snap_no FROM s)),
come AS (SELECT v.now, s.* FROM v JOIN s ON s.snap_no = v.now WHERE v.was IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.snap_no = v.was AND o.id = s.id)),
gone AS (SELECT v.now, s.* FROM v JOIN s ON s.snap_no = v.was WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.snap_no = v.now AND o.id = s.id)),
pair AS (SELECT now, text, dir, min(id) FILTER (side = 'n') AS new, min(id) FILTER (side = 'o') AS old FROM
 (SELECT now, text, dir, id, 'n' AS side FROM come UNION ALL SELECT now, text, dir, id, 'o' FROM gone) GROUP BY ALL HAVING count(*) FILTER (side = 'n') = 1 AND count(*) FILTER (side = 'o') = 1),
moved AS (SELECT * FROM pair WHERE NOT (regexp_matches(new, '^[0-9]+$') AND regexp_matches(old, '^[0-9]+$'))),
found AS (
SELECT now AS snap_no, new AS id, 'renamed' AS kind, old AS detail FROM moved
UNION ALL SELECT now, id, 'added', '' FROM come c WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.now = c.now AND m.new = c.id)
UNION ALL SELECT now, id, 'deleted', '' FROM gone c WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.now = c.now AND m.old = c.id)
{"".join(f"UNION ALL SELECT v.now, a.id, 'updated', '{c}' FROM v JOIN s a ON a.snap_no = v.now JOIN s b ON b.snap_no = v.was AND a.id = b.id WHERE a.{c} <> b.{c} " for c in FIELDS)})"""

SQL: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_TREE} SELECT id, root_id, depth, kind FROM found",
    "p1_paths": f"WITH RECURSIVE {_WALK} SELECT f.id, root_id, depth, kind, CASE WHEN depth = 0 THEN CAST(f.id AS VARCHAR) ELSE array_to_string(list_reverse(seen), '/') END AS path FROM found f LEFT JOIN walk w ON w.id = f.id AND w.k = f.depth",
    "p1_descendants": f"WITH RECURSIVE {_WALK} SELECT anc AS id, id AS descendant, k AS distance FROM walk",
    "p1_subtrees": f"WITH RECURSIVE {_WALK} SELECT f.id, count(w.id) AS n_descendants, coalesce(max(w.k), 0) AS height FROM found f LEFT JOIN walk w ON w.anc = f.id GROUP BY f.id",
    "p4_found": f"WITH {_ORPHANS} SELECT * FROM found",
    "p4_counts": f'WITH {_ORPHANS} SELECT tbl, period, count(*) AS "references", count(DISTINCT target_key) AS targets FROM found GROUP BY tbl, period',
    "p5_found": f"WITH {_CHANGES} SELECT * FROM found",
    "p5_counts": f"WITH {_CHANGES} SELECT snap_no, kind, count(DISTINCT id) AS n FROM found GROUP BY ALL",
}

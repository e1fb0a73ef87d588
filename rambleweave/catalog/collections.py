"""States of a collection compared, touches, and outliner blocks as documents, with their SQL."""

from __future__ import annotations

import hashlib
import json
import os
import re
import sqlite3
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import heading, links, strip_code, strip_frontmatter
from ..operators.graph import LinkGraph, documents
from ..operators.reconcile import collapse, diff, merge_renames, rename_touches
from ..operators.touches import TouchConfig, accepted, append, digest, last_by_key, top_sources, top_targets, touch_count, touch_stats
from ..plans.durable import cut, ensure_checkpoint_dir
from ..plans.ship import ship
from ..schema import TOUCH
from ..sources.blocks import block_documents, read_block_db
from ..sources.markdown import read_vault, read_vault_incremental
from ..sources.profile import Profile
from ..sources.store import Store
from ..streaming.digests import OUTPUT, TouchLog, digest_stream
from .common import Query, table
from .notes import SQL as NOTES_SQL
from .notes import _renames, graph


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All snapshots (snap_no and documents), and the pairs of consecutive ones (was, snap_no): one row per snapshot but the first."""
    snaps = table(spark, sf, "note_snap").where("id is not null and snap_no is not null")
    pairs = snaps.select("snap_no").distinct().withColumn("was", F.lag("snap_no").over(Window.orderBy("snap_no"))).where("was is not null")
    return documents(snaps, ("snap_no",)), pairs


def _transitions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The documents before and after each transition; snap_no is the later snapshot."""
    states, pairs = _snapshots(spark, sf)
    old = states.withColumnRenamed("snap_no", "was").join(F.broadcast(pairs), "was").drop("was")
    return old, states.join(F.broadcast(pairs.select("snap_no")), "snap_no")


def r1_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What changed in every transition of the table."""
    found = diff(*_transitions(spark, sf), by=("snap_no",)).changes
    j = lambda c: F.array_join(c, "|").alias(c)
    return found.select("snap_no", "id", "kind", j("fields"), j("refs_added"), j("refs_removed"))


def r1_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff(*_transitions(spark, sf), by=("snap_no",)).summary


def r3_renames(spark: SparkSession, sf: str) -> DataFrame:
    return diff(*_transitions(spark, sf), by=("snap_no",)).renames


def r4_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Renames from aliases of the first snapshot, as if stored, merged with those of one transition after the other; snap_no is the snapshot after which they are stored."""
    states, pairs = _snapshots(spark, sf)
    steps = sorted((r.was, r.snap_no) for r in pairs.collect())
    fresh = cut(r3_renames(spark, sf))
    out = fresh.limit(0)
    stored = _renames(states.where(F.col("snap_no") == steps[0][0])) if steps else None
    for _, now in steps:
        at = F.col("snap_no") == now
        stored = cut(merge_renames(stored, fresh.where(at), states.where(at).select("id")))
        out = out.unionByName(stored.withColumn("snap_no", F.lit(now)))
    return out


def r5_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    names = _renames(graph(spark, sf).docs)
    return collapse(names.groupBy("old_id").agg(F.max("new_id").alias("new_id")))


def touches(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "touch").distinct()


def r6_touches(spark: SparkSession, sf: str) -> DataFrame:
    names = r5_collapsed(spark, sf)
    back = names.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")).groupBy("old_id").agg(F.min("new_id").alias("new_id"))
    return rename_touches(touches(spark, sf), back)


def t1_appended(spark: SparkSession, sf: str) -> DataFrame:
    new = spark.createDataFrame([(1800000000, "shared_inbox", "hot"), (1800000001, "shared_inbox", "")], "ts long, target string, src string")
    return append(touches(spark, sf), new)


def t2_last(spark: SparkSession, sf: str) -> DataFrame:
    return last_by_key(touches(spark, sf), "seq", 5000)


def t3_stats(spark: SparkSession, sf: str) -> DataFrame:
    return touch_stats(touches(spark, sf), graph(spark, sf).docs)


def t3_targets(spark: SparkSession, sf: str) -> DataFrame:
    return top_targets(touches(spark, sf), graph(spark, sf).docs)


def t3_sources(spark: SparkSession, sf: str) -> DataFrame:
    return top_sources(touches(spark, sf))


def t4_count(spark: SparkSession, sf: str) -> DataFrame:
    return touch_count(touches(spark, sf))


def t5_digest(spark: SparkSession, sf: str) -> DataFrame:
    made = digest(touches(spark, sf), graph(spark, sf).docs, 5000, 1704067200)
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["id"], x["count"].cast("string"))), "|").alias(c)
    return made.select("window_start", "since", "total", names("targets"), names("sources"))


def _digests(spark: SparkSession, sf: str, config: TouchConfig) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    home = f"{ensure_checkpoint_dir(spark)}/digests-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(TOUCH).parquet(f"{sf}/touch.parque[t]")
    made = digest_stream(stream, config, clock=1_700_000_000)
    made.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{home}/out")


def t5_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Digests over all touches as a stream, at a fixed time: one for every 500."""
    return _digests(spark, sf, TouchConfig()).select("digest_no", "total")


def t5_stream_whole(spark: SparkSession, sf: str) -> DataFrame:
    """One digest over the whole stream, with its targets and sources; which touches meet in a smaller one depends on the order in which a stream comes."""
    made = _digests(spark, sf, TouchConfig(digest_count=table(spark, sf, "touch").count()))
    names = lambda c: F.array_join(F.transform(F.from_json(c, "array<struct<id string, count long>>"), lambda x: F.concat_ws("=", x["id"], x["count"].cast("string"))), "|").alias(c)
    return made.select("digest_no", "total", names("targets"), names("sources"))


def t9_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(touches(spark, sf), ("Shared_Inbox.md",), ("archive/",))


def s8_block_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _shown_blocks(block_documents(table(spark, sf, "block"), table(spark, sf, "block_alias"), table(spark, sf, "block_ref")))


def _shown_blocks(found: DataFrame) -> DataFrame:
    return found.select("id", "title", F.array_join("aliases", "|").alias("aliases"), "type", "path", "size", F.array_join("refs", "|").alias("refs"), F.md5("text").alias("text"))


def s5_block_db(spark: SparkSession, sf: str) -> DataFrame:
    """The block tables as a database file in the checkpoint folder, read from a snapshot of it. The file is one writer's, so its rows pass through the driver, part by part."""
    root = re.sub("^file:/*", "/", f"{ensure_checkpoint_dir(spark)}/blocks-{uuid.uuid4().hex}")
    os.makedirs(root)
    with sqlite3.connect(f"{root}/source.db") as db:
        for name, source, columns in (("Block", "block", "id, content, text, modified, parent, left_id"), ("BlockAlias", "block_alias", "name, block, pos"), ("BlockRef", "block_ref", "f, t")):
            names = columns.replace("left_id", '"left"')
            db.execute(f"CREATE TABLE {name}({names})")
            rows = table(spark, sf, source).selectExpr(*columns.split(", ")).toLocalIterator(prefetchPartitions=True)
            db.executemany(f"INSERT INTO {name} VALUES({', '.join('?' * len(columns.split(', ')))})", map(tuple, rows))
    db.close()
    return _shown_blocks(read_block_db(spark, f"{root}/source.db", root))


def s8_block_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the graph of block documents."""
    found = block_documents(table(spark, sf, "block"), table(spark, sf, "block_alias"), table(spark, sf, "block_ref"))
    return LinkGraph(cut(documents(found))).stats()


def _write_notes(root: str):  # noqa: ANN202
    """Writes rows (id, title, type, aliases, tags, text) as Markdown files with front matter, in folders and under names by a hash of the id, so that some names come twice."""

    def quoted(value: object) -> str:
        out = json.dumps(value, ensure_ascii=False)
        return re.sub("[\x7f-\xa0\u2028\u2029\ufeff]", lambda m: f"\\u{ord(m[0]):04x}", out)  # line ends of YAML, and what it does not print

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                h = hashlib.md5(r.id.encode()).hexdigest()
                os.makedirs(f"{root}/{h[3:11]}", exist_ok=True)
                front = "".join(f"{k}: {quoted(v if isinstance(v, str) else list(v))}\n" for k, v in (("title", r.title), ("type", r.type), ("aliases", r.aliases), ("tags", r.tags)))
                with open(f"{root}/{h[3:11]}/{h[:2]}.md", "w", encoding="utf-8", newline="") as f:
                    f.write(f"---\n{front}---\n{r.text}")
            yield pd.DataFrame({"n": [len(rows)]})

    return run


def s1_vault(spark: SparkSession, sf: str) -> DataFrame:
    """All notes as a folder of Markdown files in the checkpoint folder (which must be one that executors open as files), and what a scan finds there; reused is what a second scan takes over."""
    root = re.sub("^file:/*", "/", f"{ensure_checkpoint_dir(spark)}/vault-{uuid.uuid4().hex}")
    docs = graph(spark, sf).docs.select("id", "title", "type", "aliases", "tags", "text")
    docs.mapInPandas(_write_notes(root), "n long").agg(F.sum("n")).first()
    found = cut(read_vault(spark, root))
    again, taken = read_vault_incremental(spark, root, Profile(), found)
    j = lambda c: F.array_join(c, "|").alias(c)
    shown = lambda df: df.select("id", "path", "title", "type", j("aliases"), j("tags"), F.md5("text").alias("text"))
    return shown(found).exceptAll(shown(found).exceptAll(shown(again))).withColumn("reused", F.lit(taken.first()["reused"]))


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")


def s10_store(spark: SparkSession, sf: str) -> DataFrame:
    """All notes, saved and loaded again; then saved as they are, which changes nothing."""
    store = _store(spark)
    store.save(graph(spark, sf).docs)
    again = store.save(store.load())
    j = lambda c: F.array_join(c, "|").alias(c)
    return store.load().select("id", "title", j("aliases"), "type", "path", F.unix_seconds("mtime").alias("mtime"), "size", j("refs"), j("tags"), F.md5("text").alias("text"), F.lit(sum(again.values())).alias("again"))


def s14_renames(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    store.save_renames(r3_renames(spark, sf).where(F.col("snap_no") == 2))
    return store.renames()


def t7_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest over all touches, kept: what another process finds before and after it is acknowledged."""
    path, docs = f"{ensure_checkpoint_dir(spark)}/touches-{uuid.uuid4().hex}", graph(spark, sf).docs
    log = TouchLog(spark, path, docs)
    log.book.maybe(touches(spark, sf), docs, 1_704_067_200)
    before = TouchLog(spark, path, docs).book
    log.book.acknowledge()
    after = TouchLog(spark, path, docs).book
    made = before.latest()
    return spark.createDataFrame([(made["id"], made["total"], "|".join(f"{t['id']}={t['count']}" for t in made["targets"]), before.available(), after.available())], "id string, total long, targets string, fresh boolean, still boolean")


def x_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """What the parser of Markdown finds in the texts of documents: links, first heading, size without code and front matter."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.array_join(links(F.col("text")), "|").alias("links"), F.coalesce(heading(F.col("text")), F.lit("")).alias("heading"), F.char_length(strip_code(F.col("text"))).alias("plain"), F.char_length(strip_frontmatter(F.col("text"))).alias("body"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (r1_changes, r1_summary, r3_renames, r4_merged, r5_collapsed, r6_touches, t1_appended, t2_last, t3_stats, t3_targets, t3_sources, t4_count, t5_digest, t5_stream, t5_stream_whole, t9_accepted, t7_latest, s1_vault, s5_block_db, s8_block_documents, s8_block_graph, s10_store, s14_renames, x_markdown)}

_FIELDS = ("title", "type", "path", "text", "tags", "aliases", "refs")
_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, hex(encode(regexp_replace(path, '^.*/', ''))) AS h"
_SAME = "CAST(len([i FOR i IN range(1, 1 + least(len(o.h), len(n.h)) // 2) IF left(o.h, 2 * i) = left(n.h, 2 * i)]) AS DOUBLE) / greatest(len(o.h) // 2, len(n.h) // 2, 1)"
_ALL = f"""s AS (SELECT DISTINCT snap_no, id, {", ".join(f"coalesce({c}, '') AS {c}" for c in _FIELDS[:4])}, {", ".join(f"[x FOR x IN coalesce({c}, []) IF x <> ''] AS {c}" for c in _FIELDS[4:])} FROM note_snap WHERE id IS NOT NULL AND snap_no IS NOT NULL),
v AS (SELECT snap_no AS now, lag(snap_no) OVER (ORDER BY snap_no) AS was, row_number() OVER (ORDER BY snap_no) AS k FROM (SELECT DISTINCT snap_no FROM s)),
o AS (SELECT v.now, s.* EXCLUDE (snap_no), {_DIR} FROM s JOIN v ON s.snap_no = v.was), n AS (SELECT v.now, s.* EXCLUDE (snap_no), {_DIR} FROM s JOIN v ON s.snap_no = v.now WHERE v.was IS NOT NULL),
gone AS (SELECT * FROM o ANTI JOIN n USING (now, id)), come AS (SELECT * FROM n ANTI JOIN o USING (now, id)),
grp AS (SELECT now, text, dir, list({{'id': id, 'h': h}} ORDER BY id) AS olds, bool_and(bool_and(regexp_full_match(id, '[0-9]+'))) OVER (PARTITION BY now, text) AS digits FROM gone GROUP BY now, text, dir),
nws AS (SELECT now, text, dir, list({{'id': id, 'h': h}} ORDER BY id) AS news FROM come GROUP BY ALL),
claim(now, digits, olds, news, k, old_id, new_id) AS (SELECT now, digits, olds, news, 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM grp JOIN nws USING (now, text, dir)
 UNION ALL SELECT now, digits, CASE WHEN got IS NULL THEN olds ELSE [o FOR o IN olds IF o.id <> got] END, news, k + 1, got, n.id FROM (
  SELECT *, CASE WHEN NOT (digits AND regexp_full_match(n.id, '[0-9]+')) AND len([x FOR x IN alike IF x.s = top]) = 1 THEN [x FOR x IN alike IF x.s = top][1].id END AS got FROM (
   SELECT *, list_max([x.s FOR x IN alike]) AS top FROM (SELECT *, [{{'id': o.id, 's': {_SAME}}} FOR o IN olds] AS alike FROM (SELECT *, news[k + 1] AS n FROM claim WHERE k < len(news)))))),
ren AS (SELECT now, old_id, new_id FROM claim WHERE old_id IS NOT NULL),
upd AS (SELECT n.now, n.id, [f FOR f IN [{", ".join(f"CASE WHEN o.{f} <> n.{f} THEN '{f}' END" if f in _FIELDS[:4] else f"CASE WHEN list_sort(o.{f}) <> list_sort(n.{f}) THEN '{f}' END" for f in _FIELDS)}] IF f IS NOT NULL] AS fields,
 list_sort(list_distinct([r FOR r IN n.refs IF NOT list_contains(o.refs, r)])) AS added, list_sort(list_distinct([r FOR r IN o.refs IF NOT list_contains(n.refs, r)])) AS removed FROM o JOIN n USING (now, id))"""
_DOCS = "d AS (SELECT DISTINCT id, coalesce(title, '') AS title FROM (SELECT * FROM notes UNION ALL SELECT * FROM shared_note) WHERE id IS NOT NULL), t AS (SELECT DISTINCT * FROM touch)"
_TOPS = f"""{_DOCS}, tg AS (SELECT target AS id, CASE WHEN title = '' THEN target ELSE title END AS title, count(*) AS count FROM t JOIN d ON target = id WHERE seq > {{since}} GROUP BY ALL ORDER BY count DESC, id LIMIT 10),
sr AS (SELECT src AS id, count(*) AS count FROM t WHERE src <> '' AND seq > {{since}} GROUP BY src ORDER BY count DESC, id LIMIT 10)"""
_OLD = "first AS (SELECT unnest({c}) AS old_id, id AS new_id FROM {t}), ali AS (SELECT old_id, max(new_id) AS new_id FROM first WHERE old_id <> new_id GROUP BY old_id)"
_CHASE = """chase(old_id, new_id, k) AS (SELECT old_id, new_id, 0 FROM m UNION ALL SELECT c.old_id, r.new_id, k + 1 FROM chase c JOIN m r ON c.new_id = r.old_id WHERE k < 50),
col AS (SELECT old_id, new_id FROM chase WHERE new_id NOT IN (SELECT old_id FROM m) AND old_id NOT IN (SELECT new_id FROM m))"""
#: The table has six snapshots (TESTDATA), so the merged renames are written out for five transitions.
_STEPS = ", ".join(
    f"""m{k} AS (SELECT * FROM {"ali" if k == 2 else f"col{k - 1}"} WHERE EXISTS (SELECT 1 FROM v WHERE v.k = {k}) AND old_id NOT IN (SELECT id FROM n JOIN v USING (now) WHERE v.k = {k}) AND old_id NOT IN (SELECT old_id FROM ren JOIN v USING (now) WHERE v.k = {k})
 UNION ALL SELECT old_id, new_id FROM ren JOIN v USING (now) WHERE v.k = {k}), """ + _CHASE.replace("chase", f"chase{k}").replace("FROM m)", f"FROM m{k})").replace("FROM m ", f"FROM m{k} ").replace("JOIN m ", f"JOIN m{k} ").replace("col AS", f"col{k} AS")
    for k in range(2, 7)
)
_NOTE_ALIASES = "a AS (SELECT DISTINCT id, [x FOR x IN coalesce(aliases, []) IF x <> ''] AS aliases FROM (SELECT * FROM notes UNION ALL SELECT * FROM shared_note) WHERE id IS NOT NULL), " + _OLD.format(c="aliases", t="a") + ", m AS (SELECT * FROM ali)"
#: White space of any alphabet.
_SPACE = "[\\s\x0b\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_TRIM = f"regexp_replace({{0}}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_TITLE = "nullif(" + _TRIM.format("left(" + _TRIM.format("CASE WHEN strpos({0}, ' #') > 1 THEN split_part({0}, ' #', 1) ELSE {0} END") + ", 30)") + ", '')"
_BARE = _TRIM.format("regexp_replace(" + _TRIM.format("regexp_replace(" + _TRIM.format("text") + r", '(?s)\n.*$', '')") + ", '^#+', '')")
_BLOCKS = f"""b AS (SELECT DISTINCT id, text, modified, parent, coalesce(left_id, 0) AS l, content IS NULL AS page, {_BARE} AS bare FROM block),
tree(id, owner, place) AS (SELECT id, id, CAST([] AS STRUCT(l BIGINT, i BIGINT)[]) FROM b WHERE parent IS NULL OR parent NOT IN (SELECT id FROM b)
 UNION ALL SELECT c.id, CASE WHEN c.page THEN c.id ELSE t.owner END, CASE WHEN c.page THEN [] ELSE list_append(t.place, {{'l': c.l, 'i': c.id}}) END FROM tree t JOIN b c ON c.parent = t.id),
own AS (SELECT owner AS id, string_agg(CASE WHEN {_TRIM.format("coalesce(text, '')")} = '' THEN '' ELSE text END, '' ORDER BY place) AS joined, first({_TITLE.format("bare")} ORDER BY place) FILTER (len(place) = 1 AND {_TITLE.format("bare")} IS NOT NULL) AS kid FROM tree JOIN b USING (id) GROUP BY owner),
lk AS (SELECT DISTINCT x, y FROM (SELECT p.owner AS x, q.owner AS y FROM block_ref r JOIN tree p ON p.id = r.f JOIN tree q ON q.id = r.t UNION ALL SELECT t.owner, b.id FROM b JOIN tree t ON t.id = b.parent JOIN tree u ON u.id = b.id WHERE b.page) WHERE x <> y),
al AS (SELECT block AS id, list(name ORDER BY pos, name) AS aliases FROM (SELECT DISTINCT * FROM block_alias) GROUP BY block),
doc AS (SELECT b.id, page, bare, kid, {_TRIM.format("joined")} AS text, coalesce(aliases, []) AS aliases, EXISTS (SELECT 1 FROM lk WHERE x = b.id) AS linked FROM b JOIN tree ON tree.id = b.id AND tree.owner = b.id JOIN own ON own.id = b.id LEFT JOIN al ON al.id = b.id),
shell AS (SELECT id FROM doc WHERE text = '' AND len(aliases) = 0 AND NOT linked)"""
_DOCS_WHOLE = """d AS (SELECT DISTINCT id, coalesce(title, '') AS title, coalesce(type, '') AS type, coalesce(text, '') AS text, array_to_string([x FOR x IN coalesce(aliases, []) IF x <> ''], '|') AS aliases, array_to_string([x FOR x IN coalesce(tags, []) IF x <> ''], '|') AS tags
 FROM (SELECT * FROM notes UNION ALL SELECT * FROM shared_note) WHERE id IS NOT NULL)"""
_BLOCK_ROWS = f"""SELECT CAST(id AS VARCHAR) AS id, CASE WHEN text = '' AND len(aliases) = 0 THEN '容器#' || id ELSE coalesce(nullif({_TRIM.format('aliases[1]')}, ''), {_TITLE.format("bare")}, kid, CASE WHEN page THEN '页面#' ELSE '块#' END || id) END AS title,
 array_to_string(aliases, '|') AS aliases, CASE WHEN text = '' AND len(aliases) = 0 THEN 'container' WHEN page THEN 'doc' ELSE 'block' END AS type, 'block/' || id AS path, CAST(strlen(text) AS BIGINT) AS size,
 coalesce((SELECT array_to_string(list_sort(list(CAST(y AS VARCHAR))), '|') FROM lk WHERE x = doc.id AND y NOT IN (SELECT id FROM shell)), '') AS refs, md5(text) AS text FROM doc WHERE id NOT IN (SELECT id FROM shell)"""

SQL: dict[str, str] = {
    "r1_changes": f"""WITH RECURSIVE {_ALL} SELECT now AS snap_no, id, 'added' AS kind, '' AS fields, '' AS refs_added, '' AS refs_removed FROM come ANTI JOIN (SELECT now, new_id AS id FROM ren) USING (now, id)
 UNION ALL SELECT now, id, 'deleted', '', '', '' FROM gone ANTI JOIN (SELECT now, old_id AS id FROM ren) USING (now, id) UNION ALL SELECT now, id, 'updated', array_to_string(fields, '|'), array_to_string(added, '|'), array_to_string(removed, '|') FROM upd WHERE len(fields) > 0""",
    "r1_summary": f"""WITH RECURSIVE {_ALL} SELECT now AS snap_no, (SELECT count(*) FROM come c WHERE c.now = v.now) - (SELECT count(*) FROM ren r WHERE r.now = v.now) AS added, (SELECT count(*) FROM gone g WHERE g.now = v.now) - (SELECT count(*) FROM ren r WHERE r.now = v.now) AS deleted,
 (SELECT count(*) FROM upd u WHERE u.now = v.now AND len(fields) > 0) AS updated, (SELECT count(*) FROM upd u WHERE u.now = v.now AND len(fields) = 0) AS unchanged, (SELECT count(*) FROM ren r WHERE r.now = v.now) AS renamed FROM v WHERE was IS NOT NULL""",
    "r3_renames": f"WITH RECURSIVE {_ALL} SELECT now AS snap_no, old_id, new_id FROM ren",
    "r4_merged": f"""WITH RECURSIVE {_ALL}, {_OLD.format(c="aliases", t="(SELECT s.* FROM s JOIN v ON s.snap_no = v.now WHERE v.k = 1)")}, {_STEPS} {" UNION ALL ".join(f"SELECT now AS snap_no, old_id, new_id FROM col{k} JOIN v ON v.k = {k}" for k in range(2, 7))}""",
    "r5_collapsed": f"WITH RECURSIVE {_NOTE_ALIASES}, {_CHASE} SELECT * FROM col",
    "r6_touches": f"""WITH RECURSIVE {_NOTE_ALIASES}, {_CHASE}, back AS (SELECT new_id AS old, min(old_id) AS new FROM col GROUP BY new_id), t AS (SELECT DISTINCT * FROM touch)
 SELECT seq, ts, coalesce(x.new, target) AS target, coalesce(y.new, src) AS src FROM t LEFT JOIN back x ON x.old = target LEFT JOIN back y ON y.old = src""",
    "t1_appended": """WITH t AS (SELECT DISTINCT * FROM touch), m AS (SELECT max(seq) AS m FROM t), u AS (SELECT * FROM t UNION ALL SELECT m + 1, 1800000000, 'shared_inbox', 'hot' FROM m UNION ALL SELECT m + 2, 1800000001, 'shared_inbox', '' FROM m)
 SELECT * FROM u WHERE seq >= (SELECT min(seq) FROM (SELECT seq FROM u ORDER BY seq DESC LIMIT 5000))""",
    "t2_last": "WITH t AS (SELECT DISTINCT * FROM touch) SELECT * FROM t WHERE seq >= (SELECT min(seq) FROM (SELECT seq FROM t ORDER BY seq DESC LIMIT 5000))",
    "t3_stats": f"""WITH {_TOPS.format(since=-1)} SELECT 'total' AS part, 1 AS place, '' AS id, (SELECT count(*) FROM t) AS count
 UNION ALL SELECT 'target', CAST(row_number() OVER (ORDER BY count DESC, id) AS INTEGER), id, count FROM tg UNION ALL SELECT 'source', CAST(row_number() OVER (ORDER BY count DESC, id) AS INTEGER), id, count FROM sr""",
    "t3_targets": f"WITH {_TOPS.format(since=-1)} SELECT * FROM tg",
    "t3_sources": f"WITH {_TOPS.format(since=-1)} SELECT * FROM sr",
    "t4_count": "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM touch)",
    "t5_digest": f"""WITH {_TOPS.format(since=5000)} SELECT CAST(1704067200 AS BIGINT) AS window_start, '2024-01-01 00:00' AS since, (SELECT count(*) FROM t WHERE seq > 5000) AS total,
 coalesce((SELECT string_agg(id || '=' || count, '|' ORDER BY count DESC, id) FROM tg), '') AS targets, coalesce((SELECT string_agg(id || '=' || count, '|' ORDER BY count DESC, id) FROM sr), '') AS sources""",
    "t5_stream": "SELECT i AS digest_no, CAST(500 AS BIGINT) AS total FROM range(1, (SELECT count(*) FROM touch) // 500 + 1) r(i)",
    "t5_stream_whole": " ".join(["SELECT CAST(1 AS BIGINT) AS digest_no, (SELECT count(*) FROM touch) AS total", *(f", (SELECT string_agg(id || '=' || n, '|' ORDER BY n DESC, id) FROM (SELECT {c} AS id, count(*) AS n FROM touch WHERE {c} <> '' GROUP BY {c} ORDER BY n DESC, id LIMIT 10)) AS {name}" for c, name in (("target", "targets"), ("src", "sources")))]),
    "t9_accepted": "SELECT DISTINCT * FROM touch WHERE target <> '' AND lower(regexp_replace(target, '(\\.md|\\.MD)$', '')) <> 'shared_inbox' AND NOT starts_with(target, 'archive/')",
    "s5_block_db": f"WITH RECURSIVE {_BLOCKS} {_BLOCK_ROWS}",
    "s8_block_documents": f"WITH RECURSIVE {_BLOCKS} {_BLOCK_ROWS}",
    # the statistics of notes, with block documents in their place
    "s8_block_graph": NOTES_SQL["g5_stats"].replace("WITH RECURSIVE ", f"WITH RECURSIVE {_BLOCKS}, rows AS ({_BLOCK_ROWS}), ", 1).replace(
        "(SELECT * FROM notes UNION ALL SELECT * FROM shared_note)", "(SELECT * REPLACE (CASE WHEN refs = '' THEN [] ELSE string_split(refs, '|') END AS refs, CASE WHEN aliases = '' THEN [] ELSE string_split(aliases, '|') END AS aliases), CAST([] AS VARCHAR[]) AS tags FROM rows)"
    ),
    "s1_vault": f"""WITH {_DOCS_WHOLE}, f AS (SELECT *, h[4:11] AS dir, h[1:2] AS stem FROM (SELECT *, md5(id) AS h FROM d)), n AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY dir) = 1 THEN stem ELSE dir || '/' || stem END AS key FROM f)
 SELECT key AS id, dir || '/' || stem || '.md' AS path, coalesce(nullif(title, ''), nullif({_TRIM.format("regexp_extract(text, '(?m)^#[ ]+(.+?)[ ]*$', 1)")}, ''), key) AS title, coalesce(nullif(trim(type), ''), 'note') AS type, aliases, tags, md5(chr(10) || text) AS text,
 (SELECT count(*) FROM d) AS reused FROM n""",
    "s10_store": """WITH d AS (SELECT DISTINCT id, title, aliases, type, path, mtime, size, refs, tags, text FROM (SELECT * FROM notes UNION ALL SELECT * FROM shared_note) WHERE id IS NOT NULL)
 SELECT id, coalesce(title, '') AS title, array_to_string([x FOR x IN coalesce(aliases, []) IF x <> ''], '|') AS aliases, coalesce(type, '') AS type, coalesce(path, '') AS path, CAST(epoch(date_trunc('second', mtime)) AS BIGINT) AS mtime, size,
 array_to_string(list_sort(list_distinct([x FOR x IN coalesce(refs, []) IF x <> '' AND x <> id])), '|') AS refs, array_to_string([x FOR x IN coalesce(tags, []) IF x <> ''], '|') AS tags, md5(coalesce(text, '')) AS text, CAST(0 AS INTEGER) AS again FROM d""",
    "s14_renames": f"WITH RECURSIVE {_ALL} SELECT old_id, new_id FROM ren WHERE now = 2",
    "t7_latest": f"""WITH {_TOPS.format(since=0)} SELECT '1704067200-' || (SELECT max(seq) FROM t) AS id, (SELECT count(*) FROM t WHERE seq > 0) AS total, (SELECT string_agg(id || '=' || count, '|' ORDER BY count DESC, id) FROM tg) AS targets, true AS fresh, false AS still""",
    "x_markdown": r"""WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?s)```.*?```|~~~.*?~~~', ' ', 'g'), '`[^`]*`', ' ', 'g') AS code FROM documents),
 f AS (SELECT doc_id, list_concat([regexp_replace(regexp_replace(§regexp_replace(x, '(?s)[|#].*$', '')¤, '\\+$', ''), '\.md$', '') FOR x IN regexp_extract_all(coalesce(code, ''), '\[\[([^\]]+)\]\]', 1)],
  [string_split(regexp_replace(x, '\.md$', ''), '/')[-1] FOR x IN [regexp_replace(regexp_replace(y, '(?s)[#?].*$', ''), '/+$', '') FOR y IN regexp_extract_all(coalesce(code, ''), '\[[^\]]*\]\(([^)\s]+)\)', 1)] IF lower(x) LIKE '%.md' AND NOT regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*:')]) AS l FROM c)
 SELECT c.doc_id, coalesce((SELECT string_agg(v, '|' ORDER BY p) FROM (SELECT v, min(p) AS p FROM unnest(l) WITH ORDINALITY u(v, p) WHERE v <> '' AND NOT lower(§v¤) IN ('...', '…', 'wikilink') AND NOT regexp_full_match(v, '[^\s]+_[xX]{2,}') GROUP BY v)), '') AS links,
 coalesce(§regexp_extract(text, '(?m)^#\s+(.+?)\s*$', 1)¤, '') AS heading, CAST(length(code) AS INTEGER) AS plain,
 CAST(length(CASE WHEN starts_with(text, '---') AND strpos(text[4:], chr(10) || '---') > 0 THEN text[3 + strpos(text[4:], chr(10) || '---') + 4:] ELSE text END) AS INTEGER) AS body FROM c JOIN f USING (doc_id)""".replace("§", "regexp_replace(").replace("¤", f", '^{_SPACE}+|{_SPACE}+$', '', 'g')"),
}

import sqlite3
import time

import pytest
from test_graph import docs

from rambleweave.api import Collection, clamped, load_source, refresh, roam_options, to_json, to_markdown
from rambleweave.functions.text import note_uri
from rambleweave.operators import reconcile, touches
from rambleweave.schema import DOCUMENTS
from rambleweave.sources.blocks import block_documents, is_block_db, read_block_db, title_from
from rambleweave.sources import markdown
from rambleweave.sources.markdown import detect_profile, parse_yaml, read_vault, read_vault_incremental, vault_files
from rambleweave.sources.profile import BUILT_IN, Profile, is_llm_wiki, resolve_profile
from rambleweave.sources.store import Store, store_path
from rambleweave.streaming.digests import DigestBook, TouchLog, digest_stream, existing_targets, keep_log, read_log
from rambleweave.streaming.watch import FileChecker, GraphHolder, VaultChecker, Watch, file_changes


def notes(spark, *rows):
    """(id, path, text, refs)"""
    return spark.createDataFrame([(i, i, [], "note", p, None, None, r, [], t) for i, p, t, r in rows], DOCUMENTS)


def pairs(df):
    return {r.old_id: r.new_id for r in df.collect()}


def ren(spark, m):
    return spark.createDataFrame([*m.items()], "old_id string, new_id string")


@pytest.mark.parametrize(
    "old,new,expected",
    [
        ([("旧名", "d/旧名.md", "x", [])], [("新名", "d/新名.md", "x", [])], {"旧名": "新名"}),
        ([("a", "d/a.md", "x", [])], [("b", "d/b.md", "y", [])], {}),
        ([("a", "d/a.md", "x", [])], [("b", "e/b.md", "x", [])], {}),
        ([("1", "block/1", "x", [])], [("2", "block/2", "x", [])], {}),
        ([("ax", "ax.md", "x", []), ("ay", "ay.md", "x", [])], [("b", "b.md", "x", [])], {}),
        ([("abc", "abc.md", "x", []), ("zzz", "zzz.md", "x", [])], [("abd", "abd.md", "x", []), ("zzy", "zzy.md", "x", [])], {"abc": "abd", "zzz": "zzy"}),
    ],
)
def test_renames(spark, old, new, expected):
    assert pairs(reconcile.diff(notes(spark, *old), notes(spark, *new)).renames) == expected


def test_diff(spark):
    old = notes(spark, ("a", "d/a.md", "m", []), ("gone", "x/g.md", "g", []), ("u", "u.md", "1", ["p", "q"]), ("s", "s.md", "s", ["x", "y"]))
    new = notes(spark, ("b", "d/b.md", "m", []), ("come", "y/c.md", "c", []), ("u", "u.md", "2", ["q", "r"]), ("s", "s.md", "s", ["y", "x"]))
    got = reconcile.diff(old, new)
    assert tuple(got.summary.select("added", "deleted", "updated", "unchanged", "renamed").first()) == (1, 1, 1, 1, 1)
    rows = {r.id: (r.kind, r.fields, r.refs_added, r.refs_removed) for r in got.changes.collect()}
    assert rows == {"gone": ("deleted", [], [], []), "come": ("added", [], [], []), "u": ("updated", ["text", "refs"], ["r"], ["p"])}
    nothing = reconcile.diff(old.limit(0), old.limit(0))
    assert nothing.changes.count() == 0 and nothing.summary.first().added == 0


@pytest.mark.parametrize("m,expected", [({"A": "B", "B": "C"}, {"A": "C"}), ({"A": "B", "X": "Y"}, {"A": "B", "X": "Y"}), ({"A": "B", "B": "A"}, {}), ({"A": "B"}, {"A": "B"}), ({f"n{i}": f"n{i + 1}" for i in range(20)}, {"n0": "n20"})])
def test_collapse(spark, m, expected):
    assert pairs(reconcile.collapse(ren(spark, m))) == expected


def test_merge(spark):
    got = reconcile.merge_renames(ren(spark, {"back": "x", "kept": "y", "over": "z"}), ren(spark, {"over": "w", "new": "v"}), notes(spark, ("back", "", "", [])))
    assert pairs(got) == {"kept": "y", "over": "w", "new": "v"}


def test_rename_touches(spark):
    t = spark.createDataFrame([(1, 1, "旧A", "来源"), (2, 2, "旧B", "旧A"), (3, 3, None, None)], "seq long, ts long, target string, src string")
    rows = reconcile.rename_touches(t, ren(spark, {"旧A": "新B"})).orderBy("seq").collect()
    assert [(r.target, r.src) for r in rows] == [("新B", "来源"), ("旧B", "新B"), (None, None)]


TOUCH = "seq long, ts long, target string, src string"


def test_touches(spark):
    d = docs(spark, ("热点A", "甲", "", []), ("热点B", "", "", []))
    rows = [("热点A", "来源X")] * 3 + [("热点A", "来源Y"), ("热点B", ""), ("幽灵节点", "来源Z")]
    log = spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows, 1)], TOUCH)
    stats = [tuple(r) for r in touches.touch_stats(log, d).orderBy("part", "place").collect()]
    assert ("total", 1, "", 6) in stats and ("target", 1, "热点A", 4) in stats and ("target", 2, "热点B", 1) in stats and ("source", 1, "来源X", 3) in stats
    assert not any(r[2] == "幽灵节点" for r in stats) and any(r[2] == "来源Z" for r in stats)
    many = spark.range(1, 5006).selectExpr("id AS seq", "id AS ts", "'a' AS target", "'b' AS src")
    assert touches.last_by_key(many, "seq", 5000).agg({"seq": "min"}).first()[0] == 6 and touches.last_by_key(log.limit(0), "seq", 5).count() == 0
    more = touches.append(log, spark.createDataFrame([(9, "x", None), (8, "y", "z")], "ts long, target string, src string"), 3)
    assert [(r.seq, r.target) for r in more.orderBy("seq").collect()] == [(6, "幽灵节点"), (7, "y"), (8, "x")]
    assert touches.accepted(spark.createDataFrame([(1, 1, t, "") for t in ("Index", "log_x", "", None, "fine")], TOUCH), ("index.md",), ("log_",)).first().target == "fine"


def test_config():
    c = touches.TouchConfig
    assert c.parse("digest_count: 700\nbackup_max: 3") == c(600, 3, 3) and c.parse(None) == c() and c.parse(": [broken") == c() and c.parse("digest_days: 0") == c(500, 1, 5) and c.parse("- 1") == c()


def test_digest_book(spark):
    d = docs(spark, ("A", "甲", "", []), ("B", "乙", "", []))
    log = lambda *t: spark.createDataFrame([(i, i, x, "s") for i, x in enumerate(t, 1)], TOUCH)
    book = DigestBook(touches.TouchConfig(3, 3, 2))
    assert book.maybe(log("A", "A"), d, 100) is None
    made = book.maybe(log("A", "A", "B"), d, 200)
    assert made["total"] == 3 and [(t["id"], t["title"], t["count"]) for t in made["targets"]] == [("A", "甲", 2), ("B", "乙", 1)] and made["window_start"] == 200
    assert book.available()
    book.acknowledge()
    assert not book.available() and book.maybe(log("A", "A", "B"), d, 300) is None
    late = book.maybe(log("A", "A", "B", "ghost"), d, 200 + 3 * 86400)
    assert late["total"] == 1 and late["targets"] == [] and late["window_start"] == 200
    empty = book.maybe(log("A", "A", "B", "ghost"), d, 200 + 6 * 86400)
    assert empty["total"] == 0 and len(book.backups) == 2


def test_digest_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "seq long, ts long, target string, src string"
    for k, rows in enumerate([[("A", "s"), ("A", None)], [("B", "s"), ("ghost", ""), ("A", "t"), ("A", "t"), (None, "t")]]):
        spark.createDataFrame([(10 * k + i, i, *r) for i, r in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        q = digest_stream(stream, touches.TouchConfig(3, 3, 5), clock=1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("digest_no").collect()
    assert [(r.digest_no, r.total, r.window_start) for r in got] == [(1, 3, 1000), (2, 3, 1000)]
    assert sum(x["count"] for r in got for x in __import__("json").loads(r.targets)) + 0 in (5, 6)
    titled = existing_targets(spark.read.parquet(str(tmp_path / "out")), docs(spark, ("A", "甲", "", [])))
    assert {r.title for r in titled.collect()} == {"甲"}


def test_log_stream(spark, tmp_path):
    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    for k in range(3):
        spark.range(k * 4, k * 4 + 4).selectExpr("id AS seq", "id AS ts", "'a' AS target", "'b' AS src").coalesce(1).write.mode("append").parquet(path)
        q = spark.readStream.schema(TOUCH).parquet(path).writeStream.foreachBatch(keep_log(log, 6)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert [r.seq for r in read_log(spark, log).orderBy("seq").collect()] == [*range(6, 12)]


VAULT = {
    "a/甲.md": "---\ntitle: First\naliases: [One, Two]\ntags:\n  - x\n  - ''\n  - y\ntype: 人物\nbind: '[[bound]]'\n---\n# Head\n[[b/甲|other]] [[t#part]] `[[code]]`\n```\n[[fenced]]\n```\n[m](dir/乙.md#x) [w](https://e.org/z.md) [[人物_xxx]] [[wikilink]] [[人物_003\\]]",
    "b/甲.md": "no front matter\n# Second head  \n",
    "乙.md": "---\nhero_name: Hero\ndescription: about\nresource: http://r\n---\nbody",
    ".obsidian/x.md": "hidden",
    "skip_me.md": "x",
    "Index.md": "x",
    "note.txt": "x",
    "empty.md": "",
}


def write_vault(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")


def test_vault(spark, tmp_path):
    write_vault(tmp_path, VAULT)
    profile = Profile(excluded_files=("index.md",), excluded_prefixes=("skip_",), type_by_dir=(("b", "dir b"),), type_by_key=(("hero", "role"),))
    full = read_vault(spark, str(tmp_path), profile).cache()
    got = {r.id: r for r in full.collect()}
    assert set(got) == {"甲", "b/甲", "乙", "empty"} and got["empty"].text == ""
    one = got["甲"]
    assert (one.title, one.aliases, one.tags, one.type, one.path) == ("First", ["One", "Two"], ["x", "y"], "人物", "a/甲.md")
    assert one.refs == ["bound", "b/甲", "t", "人物_003", "乙"] and one.text.startswith("\n# Head")
    assert (got["b/甲"].title, got["b/甲"].type, got["乙"].title, got["乙"].type) == ("Second head", "dir b", "Hero", "role")
    assert got["乙"].text == "about\n资源: http://r\n\n\nbody"
    again, reused = read_vault_incremental(spark, str(tmp_path), profile, full)
    assert reused.first().reused == 4 and sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)
    write_vault(tmp_path, {"乙.md": "changed [[甲]]", "new.md": "n"})
    again, reused = read_vault_incremental(spark, str(tmp_path), profile, full)
    assert reused.first().reused == 3
    strip = lambda df: sorted((tuple(r[:5]) + tuple(r[6:]) for r in df.collect()), key=repr)
    assert strip(again) == strip(read_vault(spark, str(tmp_path), profile))


def test_vault_of_many_folders(spark, tmp_path):
    """Files of many folders are found once each, with few tasks; names with a dot or an underscore in front are files like others; a scan is not taken for an earlier one."""
    files = {f"d{i}/e/n{i}.md": f"text {i}" for i in range(300)} | {".dot.md": "a", "_under/_b.MD": "b", ".git/no.md": "x", "d1/.obsidian/no.md": "x", "d2/empty.md": ""}
    write_vault(tmp_path, files)
    (tmp_path / "link").symlink_to(tmp_path / "d3")
    (tmp_path / "linked.md").symlink_to(tmp_path / "d3/e/n3.md")
    found = read_vault(spark, str(tmp_path)).cache()
    want = {k: v for k, v in files.items() if "no.md" not in k} | {"linked.md": "text 3"}
    assert sorted((r.path, r.text, r.size) for r in found.collect()) == sorted((k, v, len(v)) for k, v in want.items())
    listed = vault_files(spark, str(tmp_path), Profile())
    assert listed.rdd.getNumPartitions() <= 9 and {r.path for r in listed.collect()} == set(want)
    assert listed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 40  # not taken for small, or joins would send all texts to the driver
    write_vault(tmp_path, {"d4/e/n4.md": "TEXT 4", "new/x.md": "new"})
    assert {r.path: r.text for r in read_vault(spark, str(tmp_path)).collect()} == want | {"d4/e/n4.md": "TEXT 4", "new/x.md": "new"}
    assert {r.path: r.text for r in read_vault(spark, f"file://{tmp_path}/").collect()} == want | {"d4/e/n4.md": "TEXT 4", "new/x.md": "new"}


def test_simple_front_matter(monkeypatch):
    """Simple lines are read without the parser of YAML, as that reads them."""
    blocks = ['\ntitle: "a \\" b \\\\ \\n 目 😀"\ntags: ["x", "", "y: z"]\ntags: ["w"]\naliases: []\ntitle: "last"', 'a: ""\n', 'no: "x"', 'a: "\\u0041"', 'a: "x" # c', 'a: [x]', 'a: "\u2028"', 'a: "\x7f"', 'a: "b"\n\nc: "d"', '"a": "b"', 'a: "b']
    simple = [markdown._simple_yaml(b) for b in blocks]
    assert [x is not None for x in simple] == [True, True, *[False] * 9]
    fast = [parse_yaml(b) for b in blocks]
    monkeypatch.setattr(markdown, "_simple_yaml", lambda b: None)
    assert fast == [parse_yaml(b) for b in blocks] and fast[0] == ({"title": "last", "tags": "", "aliases": ""}, {"tags": ["x", "y: z", "w"]})


@pytest.mark.parametrize(
    "block,meta,lists",
    [
        ("a: 1.50\nb: true\nc:\nd: [x, 'y']\ne:\n  k: v\n", {"a": "1.50", "b": "true", "c": "", "d": "", "e": ""}, {"d": ["x", "y"]}),
        ("123: n\nkebab-key: n\nvalid: y", {"valid": "y"}, {}),
        ("a: 1\na: 2", {"a": "2"}, {}), ("a: [broken", {}, {}), ("- list", {}, {}), (None, {}, {}), ("", {}, {}),
        ('t: "q\\n"\nf: >-\n  one\n  two\n', {"t": "q\n", "f": "one two"}, {}),
    ],
)
def test_front_matter(block, meta, lists):
    assert parse_yaml(block) == (meta, lists)


def test_profiles(spark, tmp_path):
    assert resolve_profile(name="okf") == Profile() and resolve_profile(name="llm-wiki").structural_types == () and BUILT_IN["example-wiki"].default_type == "其他"
    with pytest.raises(KeyError):
        resolve_profile(name="none")
    assert resolve_profile(vault=str(tmp_path)) == Profile() and (tmp_path / ".rambleweave/profile.yaml").exists()
    (tmp_path / ".rambleweave/profile.yaml").write_text("name: own\nstructural_types: [toc]\ntype_by_dir: [{pattern: w, type: W}]")
    own = resolve_profile(vault=str(tmp_path))
    assert (own.name, own.structural_types, own.type_by_dir, own.title_keys) == ("own", ("toc",), (("w", "W"),), ("title",))
    assert Profile.parse(own.dump()) == own and own.signature() != Profile().signature()
    write_vault(tmp_path, {**{f"人物_{i}.md": "---\nname: x\nchapter_id: 1\nbook_title: b\n---\n" for i in range(3)}, "log/a.md": "", "log/b.md": "", "one/a.md": "", ".ingest-1.md": "", "d.excalidraw.md": "", ".tool/t.md": "", "raw/r.md": "", "wiki/index.md": ""})
    got = detect_profile(spark, str(tmp_path))
    assert got.type_by_dir == (("log", "log"),) and got.type_by_prefix == (("人物_", "人物"), (".ingest", "报告")) and got.type_by_ext == ((".excalidraw", "画布"),)
    assert got.title_keys == ("name", "book_title") and got.structural_types == ("container", "log", "报告", "画布", "章节") and ".tool" in got.excluded_dirs
    assert is_llm_wiki(str(tmp_path)) and not is_llm_wiki(str(tmp_path / "raw"))


BLOCKS = [
    (1, None, None, 10, None, None), (2, "[]", "# Title #tag more", 10, 1, 5), (3, "[]", "second", 10, 1, None), (4, "[]", "deep", 10, 2, None), (5, None, None, 10, 1, None), (6, "[]", "in five", 10, 5, None),
    (7, "[]", "top block", 10, 99, None), (8, "[]", "below", 10, 7, None), (9, None, None, 10, None, None), (10, None, " ", 10, None, None), (11, "[]", "loop", 10, 12, None), (12, "[]", "loop", 10, 11, None),
    (13, None, None, 10, None, None), (14, "[]", "", 10, 13, None),
]
ALIASES = [("Five", 5, 1), ("Cinq", 5, 0), ("Five", 5, 1)]
REFS = [(4, 8), (3, 6), (3, 3), (2, 777), (14, 7), (4, 8), (None, 3)]


def test_blocks(spark, tmp_path):
    assert is_block_db("x.DB") and not is_block_db("x.md")
    path = str(tmp_path / "o.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE Block(id INTEGER, content TEXT, text TEXT, modified INTEGER, parent INTEGER, "left" INTEGER)')
        db.execute("CREATE TABLE BlockAlias(name TEXT, block INTEGER, pos INTEGER)")
        db.execute("CREATE TABLE BlockRef(f INTEGER, t INTEGER)")
        db.executemany("INSERT INTO Block VALUES(?,?,?,?,?,?)", BLOCKS)
        db.executemany("INSERT INTO BlockAlias VALUES(?,?,?)", ALIASES)
        db.executemany("INSERT INTO BlockRef VALUES(?,?)", REFS)
    got = {r.id: r for r in read_block_db(spark, path, str(tmp_path)).collect()}
    assert set(got) == {"1", "5", "7", "13"}
    one = got["1"]  # by left: 3 (0), then 2 (5) and what is below it
    assert (one.text, one.type, one.refs, one.title, one.size) == ("second# Title #tag moredeep", "doc", ["5", "7"], "second", 27)
    assert (got["5"].title, got["5"].aliases, got["5"].text) == ("Cinq", ["Cinq", "Five"], "in five")
    assert (got["7"].title, got["7"].type, got["7"].text) == ("top block", "block", "top blockbelow")
    assert (got["13"].type, got["13"].title, got["13"].refs) == ("container", "容器#13", ["7"])
    with pytest.raises(Exception, match="not among"):
        spark.read.format("block_database").option("path", path).option("table", "Secrets").load().count()
    assert {r.id for r in load_source(spark, path).collect()} == set(got)
    empty = block_documents(spark.createDataFrame([], "id long, content string, text string, modified long, parent long, left_id long"), spark.createDataFrame([], "name string, block long, pos int"), spark.createDataFrame([], "f long, t long"))
    assert empty.count() == 0


def test_block_titles(spark):
    df = spark.createDataFrame([("##  A line #tag\nnext",), ("x" * 40,), ("  ",), (None,), (" #only",)], "text string")
    assert [r[0] for r in df.select(title_from(df["text"])).collect()] == ["A line", "x" * 30, None, None, "only"]


def test_store_and_refresh(spark, tmp_path):
    vault = tmp_path / "v"
    write_vault(vault, {"a.md": "text a [[b]] [[b]]", "b.md": "text b", "old.md": "unique"})
    store = Store(spark, store_path(str(vault)))
    assert store_path(str(vault) + "/.") == store_path(str(vault)) and store.load().count() == 0 and store.stale(Profile())
    first, _ = refresh(spark, str(vault), store, Profile())
    assert first.changes.summary.first().added == 3 and not store.stale(Profile()) and store.stale(Profile(default_type="x"))
    assert {r.id: r.refs for r in store.load().collect()} == {"a": ["b"], "b": [], "old": []}
    assert store.save(store.load()) == {"put": 0, "deleted": 0}
    (vault / "old.md").rename(vault / "new.md")
    (vault / "b.md").write_text("text b 2")
    log = spark.createDataFrame([(1, 1, "old", "x")], TOUCH)
    second, led = refresh(spark, str(vault), store, Profile(), log)
    assert second.reused == 1 and pairs(store.renames()) == {"old": "new"} and led.first().target == "new"
    assert tuple(second.changes.summary.select("added", "deleted", "updated", "renamed").first()) == (0, 0, 1, 1)
    assert {r.id for r in load_source(spark, str(vault), Profile(), store).collect()} == {"a", "b", "new"}
    third, _ = refresh(spark, str(vault), store, Profile(), full=True)
    assert third.reused == 0 and third.changes.changes.count() == 0


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.save(docs(spark, ("a", "A", "", ["b"])))
    before = store.facts()

    def crash(**_):
        raise KeyboardInterrupt

    # a save that ends between writing the new generation and pointing to it
    with monkeypatch.context() as m:
        m.setattr(store, "put", crash)
        with pytest.raises(KeyboardInterrupt):
            store.save(docs(spark, ("b", "B", "", [])))
    assert Store(spark, store.path).facts() == before and [r.id for r in Store(spark, store.path).load().collect()] == ["a"]
    # one that ends after writing the new facts, before they appear under their name
    (tmp_path / "s" / "facts.json.new").write_text("{half")
    assert store.facts() == before and store.save(docs(spark, ("b", "B", "", []))) == {"put": 1, "deleted": 1}
    assert [r.id for r in store.load().collect()] == ["b"]


def test_touch_log(spark, tmp_path):
    d = docs(spark, ("a", "A", "", []))
    new = lambda *t: spark.createDataFrame([(i, x, "s") for i, x in enumerate(t)], "ts long, target string, src string")
    log = TouchLog(spark, str(tmp_path / "t"), d, touches.TouchConfig(3, 3, 2), kept=4)
    log.touch(new("a", "b"))
    assert log.digest(100) is None and not log.book.available()
    log.touch(new("a", "a", "a"))
    assert [r.seq for r in log.touches().orderBy("seq").collect()] == [2, 3, 4, 5] and log.digest(200)["total"] == 4 and log.book.available()
    again = TouchLog(spark, log.path, d, touches.TouchConfig(3, 3, 2), kept=4)
    assert again.book.available() and again.book.latest() == log.book.latest() and again.digest(300) is None
    again.book.acknowledge(again.book.latest()["id"])
    assert not TouchLog(spark, log.path, d).book.available() and again.stats().where("part = 'total'").first()["count"] == 4


def test_digest_by_time_alone(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(i, 1, "a", None) for i in range(4)], TOUCH).write.parquet(path)
    made = digest_stream(spark.readStream.schema(TOUCH).parquet(path), touches.TouchConfig(3, 2 / 86400, 5))
    q = made.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("timed").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    rows = spark.table("timed").orderBy("digest_no").limit(2).collect()
    # no touch came after the first three and one more: the second digest is the timer's
    assert [(r.digest_no, r.total, r.targets) for r in rows] == [(1, 3, '[{"id": "a", "count": 3}]'), (2, 1, '[{"id": "a", "count": 1}]')] and rows[1].generated_at - rows[0].generated_at >= 2


def test_watch(spark, tmp_path):
    write_vault(tmp_path, {"a.md": "x", ".git/b.md": "x"})
    check = VaultChecker(spark, str(tmp_path), Profile())
    assert check() and not check()
    write_vault(tmp_path, {"c.md": "y", ".git/d.md": "x"})
    assert check() and not check()
    (tmp_path / "a.md").unlink()
    assert check()
    f = FileChecker(str(tmp_path / "c.md"))
    assert f() and not f()
    now, calls, fail = [0.0], [], [True]

    def do():
        if fail[0]:
            raise OSError
        calls.append(now[0])

    w = Watch(lambda: now[0] in (0, 70), do, 60, lambda: now[0])
    assert not w.step() and w.pending
    fail[0] = False
    assert w.step() and not w.pending
    now[0] = 50
    w.pending = True
    assert not w.step()
    now[0] = 70
    assert w.step() and calls == [0.0, 70]
    before = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, mtime long, size long")
    after = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, mtime long, size long")
    assert {r.path: r.kind for r in file_changes(before, after).collect()} == {"b": "changed", "c": "deleted", "d": "added"}
    h = GraphHolder()
    c = Collection(docs(spark, ("a", "A", "", ["b"]), ("b", "B", "", [])))
    assert h.replace(c.graph) == 1 and h.replace(c.graph) == 2 and h.graph is c.graph


def test_collection(spark):
    c = Collection(docs(spark, ("a", "Alpha", "note", ["b", "c"]), ("b", "Beta", "note", ["c", "d"]), ("c", "Gamma", "note", ["e"]), ("d", "Delta", "note", ["zz"]), ("e", "Epsilon", "note", ["a"]), *[(f"p{i}", "", "note", []) for i in range(6)]), vault="my vault")
    out = c.roam("Alpha", top="5", hops=99, decay="x")
    assert roam_options(top=0, hops=99, alpha=-1).__dict__ == {"top": 1, "hops": 5, "decay": 0.7, "least": 0.1, "alpha": 0.0, "beta": 0.5} and clamped(None, 3, 0, 9) == 3
    text = to_markdown(out, "Alpha")
    assert "## Anchors" in text and "1-hop" in text and '"fallback": 0' in to_json(out)
    assert "nothing found" in to_markdown(c.roam(" "), "")
    assert c.relation("Alpha", "Delta")[0].first().hops == 2 and c.relation("nobody", "a") is None
    assert c.similar("Alpha").first().shared_titles and c.similar("nobody") is None and c.node("Beta").first().deg == 3
    assert c.dangling().first().target == "zz" and c.stats().first().nodes == 11 and c.suggest(1).count() == 1 and c.communities(top=1).count() == 1 and c.hot(2).count() == 2 and c.search("x").count() == 0
    assert c.with_uri(c.hot(1)).first().uri.startswith("obsidian://open?vault=my+vault&file=") and c.random(seed=3).random
    df = spark.createDataFrame([("p.md", "7"), (None, None)], "path string, id string")
    assert [r[0] for r in df.select(note_uri(df["path"], df["id"], "", "re po")).collect()] == ["orca-note://re+po/block?blockId=7", ""]

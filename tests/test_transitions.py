from pyspark.sql import functions as F

from rambleweave import queries
from rambleweave.functions.text import links, trimmed
from rambleweave.operators.reconcile import detect_renames

SCHEMA = "snap_no int, id string, title string, type string, path string, text string, tags array<string>, aliases array<string>, refs array<string>"


def test_every_transition(spark, tmp_path):
    doc = lambda no, i, text, path="d/x.md", title="t", aliases=(): (no, i, title, "note", path, text, [], list(aliases), [])
    rows = [
        doc(1, "a", "A", aliases=["was"]), doc(1, "b", "B"), doc(1, "x", "S", "d/note-x.md"), doc(1, "y", "S", "d/other.md"),
        doc(2, "a2", "A"), doc(2, "b", "B"), doc(2, "x", "S", "d/note-x.md"), doc(2, "y", "S", "d/other.md"),
        doc(4, "a3", "A"), doc(4, "b", "B2"), doc(4, "z", "S", "d/note-z.md"), doc(4, "c", "C"), doc(4, "c", "C"),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/note_snap.parquet")
    got = lambda name: sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert got("r3_renames") == [(2, "a", "a2"), (4, "a2", "a3"), (4, "x", "z")]
    assert got("r1_changes") == [(4, "b", "updated", "text", "", ""), (4, "c", "added", "", "", ""), (4, "y", "deleted", "", "", "")]
    assert got("r1_summary") == [(2, 0, 0, 0, 3, 1), (4, 1, 1, 1, 0, 2)]
    # 'was' leads on to a, which was renamed twice; each merge keeps the heads of chains only.
    merged = [{c: r[c] for c in ("snap_no", "old_id", "new_id")} for r in queries.QUERIES["r4_merged"](spark, str(tmp_path)).collect()]
    assert sorted(tuple(r.values()) for r in merged) == [(2, "was", "a2"), (4, "was", "a3"), (4, "x", "z")]


def test_digits_guard_looks_at_every_directory(spark):
    rows = lambda *ids: spark.createDataFrame([(i, "same", p) for i, p in ids], "id string, text string, path string")
    got = lambda old, new: sorted(tuple(r) for r in detect_renames(rows(*old), rows(*new)).collect())
    assert got([("12", "d/12.md")], [("34", "d/34.md")]) == []
    # a candidate elsewhere that is not all digits lifts the guard, though it is no candidate itself
    assert got([("12", "d/12.md"), ("x", "e/x.md")], [("34", "d/34.md")]) == [("12", "34")]
    assert got([("12", "d/12.md"), ("13", "e/13.md")], [("34", "d/34.md"), ("y", "e/y.md")]) == [("13", "y")]
    # contested: the more alike name is taken first, and once
    assert got([("ab", "d/ab.md"), ("ax", "d/ax.md")], [("abc", "d/abc.md"), ("axe", "d/axe.md")]) == [("ab", "abc"), ("ax", "axe")]


def test_white_space_of_any_alphabet(spark):
    df = spark.createDataFrame([("[[　name ]] [[  other |x]] [[　...　]]", "　title\u0085")], "text string, title string")
    assert df.select(links(F.col("text")), trimmed(F.col("title"))).first() == (["name", "other"], "title")

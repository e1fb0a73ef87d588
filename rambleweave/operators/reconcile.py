"""Comparing two states of a collection, and keeping track of documents that changed their id."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, directory, is_numeric
from ..plans.durable import cut

FIELDS = ("title", "type", "path", "text", "tags", "aliases", "refs")
_LISTS = {"tags", "aliases", "refs"}


@dataclass
class Reconciled:
    """changes: id, kind (added, deleted, updated), fields, refs_added, refs_removed. renames: old_id, new_id. summary: one row of counts."""

    changes: DataFrame
    renames: DataFrame
    summary: DataFrame


def differing(old: str = "old", new: str = "new") -> Column:
    """Names of the fields in which two structs of a document differ; lists are compared without order."""
    side = lambda s, f: F.array_sort(F.col(s)[f]) if f in _LISTS else F.col(s)[f]
    return F.filter(F.array(*[F.when(~side(old, f).eqNullSafe(side(new, f)), f) for f in FIELDS]), lambda x: x.isNotNull())


def diff(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> Reconciled:
    """What changed between two sets of documents (each id once). Times and sizes don't count; a renamed document is neither added nor deleted. by: columns that tell several such pairs of sets apart; all three results have them, and ids count within them."""
    keys = [*by, "id"]
    rows = lambda df, name: df.select(*keys, F.struct(*FIELDS).alias(name))
    both = rows(old, "old").join(rows(new, "new"), keys, "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.size(differing()) > 0, "updated").otherwise("unchanged")
    none = F.array().cast("array<string>")
    changed = F.when(F.col("kind") == "updated", differing()).otherwise(none)
    less = lambda a, b: F.when(F.col("kind") == "updated", F.array_sort(F.array_except(F.col(a)["refs"], F.col(b)["refs"]))).otherwise(none)
    lone = lambda c: F.when(F.col("kind") == "deleted", F.col("old")[c]).when(F.col("kind") == "added", F.col("new")[c]).alias(c)
    # Cut, as it is read again and again; texts are kept of deleted and added documents only.
    marked = cut(both.withColumn("kind", kind).select(*keys, "kind", changed.alias("fields"), less("new", "old").alias("refs_added"), less("old", "new").alias("refs_removed"), lone("text"), lone("path")))
    renames = detect_renames(marked.where("kind = 'deleted'").select(*keys, "text", "path"), marked.where("kind = 'added'").select(*keys, "text", "path"), by)
    ends = renames.select(*by, F.explode(F.array("old_id", "new_id")).alias("id"))
    changes = marked.where("kind <> 'unchanged'").join(ends, keys, "left_anti").select(*keys, "kind", "fields", "refs_added", "refs_removed")
    return Reconciled(changes, renames, summary(marked, renames, by))


def summary(marked: DataFrame, renames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each value of by): added, deleted, updated, unchanged, renamed; a rename is taken off added and deleted."""
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    on = [*by, "_"]
    counts = marked.groupBy(*by).agg(n("added"), n("deleted"), n("updated"), n("unchanged")).withColumn("_", F.lit(1))
    renamed = renames.groupBy(*by).agg(F.count("*").alias("renamed")).withColumn("_", F.lit(1))
    one = counts.join(renamed, on, "left").drop("_").withColumn("renamed", F.coalesce("renamed", F.lit(0).cast("long")))
    return one.withColumns({k: F.col(k) - F.col("renamed") for k in ("added", "deleted")})


def _claim(pdf: pd.DataFrame) -> pd.DataFrame:
    """Within one text and directory: new ids in order claim the old id whose file name starts most alike; on a tie none."""
    gone = [(r.id, r.name_bytes) for r in pdf[pdf["gone"]].sort_values("id").itertuples()]
    come = [(r.id, r.name_bytes) for r in pdf[~pdf["gone"]].sort_values("id").itertuples()]
    numeric = bool(pdf["digits"].iat[0])
    out = []
    for new, name in come:
        if numeric and new.isascii() and new.isdigit():
            continue
        best, score, tie = None, -1.0, False
        for k, (_, other) in enumerate(gone):
            same = 0
            for x, y in zip(name, other):
                if x != y:
                    break
                same += 1
            s = 0.9 + 0.1 * same / max(len(name), len(other), 1)
            if s > score:
                best, score, tie = k, s, False
            elif s == score:
                tie = True
        if best is not None and not tie:
            out.append((gone.pop(best)[0], new))
    return pd.DataFrame(out, columns=["old_id", "new_id"])


def detect_renames(deleted: DataFrame, added: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """old_id, new_id (after the columns by, within whose values pairs are sought): a deleted and an added document (id, text, path) of the same text and directory.

    Among several, new ids in order take the old one whose file name has the longest common start, unless that is a
    tie; a new id that is all digits is not paired if all deleted ids of its text, in any directory, are. Groups that only one side has are dropped before
    anything is grouped; what is grouped has ids and file names, no texts.
    """
    side = lambda df, gone: df.select(*by, "id", F.sha2("text", 256).alias("sha"), directory(F.col("path")).alias("dir"), F.encode(basename(F.col("path")), "UTF-8").alias("name_bytes"), F.lit(gone).alias("gone"))
    x, y = side(deleted, True), side(added, False)
    on = [*by, "sha", "dir"]
    digits = x.groupBy(*by, "sha").agg(F.every(is_numeric(F.col("id"))).alias("digits"))
    both = x.join(y.select(on).distinct(), on, "left_semi").unionByName(y.join(x.select(on).distinct(), on, "left_semi")).join(digits, [*by, "sha"])

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        return _claim(pdf).assign(**{c: pdf[c].iat[0] for c in by})[[*by, "old_id", "new_id"]]

    return both.groupBy(on).applyInPandas(claim, ", ".join([*(f"{c} {kind}" for c, kind in x.dtypes if c in by), "old_id string", "new_id string"]))


def final_names(renames: DataFrame) -> DataFrame:
    """old_id, new_id with every old name led to the last name of its chain; names whose chain runs into a cycle are left out. By doubling: the number of rounds is the logarithm of the longest chain."""
    m = cut(renames.groupBy("old_id").agg(F.max("new_id").alias("new_id")))
    steps = m
    for _ in range(m.count().bit_length() + 1):
        further = steps.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("then"))
        met = cut(steps.join(further, "new_id", "left").select("old_id", F.coalesce("then", "new_id").alias("new_id"), F.col("then").isNotNull().alias("open")))
        steps = met.select("old_id", "new_id")
        if met.where("open").isEmpty():
            return steps
    # After more steps than there are names, what still leads on leads around.
    return steps.join(m.select(F.col("old_id").alias("new_id")), "new_id", "left_anti").select("old_id", "new_id")


def collapse(renames: DataFrame) -> DataFrame:
    """Only heads of chains, led to their last name; a map of one entry stays as it is."""
    if renames.limit(2).count() < 2:
        return renames
    heads = renames.join(renames.select(F.col("new_id").alias("old_id")), "old_id", "left_anti").select("old_id")
    return final_names(renames).join(heads, "old_id", "left_semi").where("old_id <> new_id")


def merge_renames(stored: DataFrame, fresh: DataFrame, current: DataFrame) -> DataFrame:
    """Stored renames, without those whose old id is there again, overridden by fresh ones, and collapsed. current: documents (id)."""
    kept = stored.join(current.select(F.col("id").alias("old_id")), "old_id", "left_anti").join(fresh.select("old_id"), "old_id", "left_anti")
    return collapse(kept.select("old_id", "new_id").unionByName(fresh.select("old_id", "new_id")))


def redirected(docs: DataFrame, renames: DataFrame) -> DataFrame:
    """Documents whose references are led along renames; a document's references lose repetitions only if one changed."""
    to = final_names(renames).withColumnRenamed("old_id", "ref")
    refs = docs.select("id", F.posexplode("refs").alias("pos", "ref")).join(to, "ref", "left")
    moved = refs.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new_id", "ref").alias("to")))), lambda x: x["to"]).alias("led"), F.max(F.col("new_id").isNotNull()).alias("changed")
    ).where("changed")
    joined = docs.join(moved, "id", "left").withColumn("refs", F.when(F.col("changed"), F.array_distinct("led")).otherwise(F.col("refs")))
    return joined.select(*docs.columns)


def rename_touches(touches: DataFrame, renames: DataFrame) -> DataFrame:
    """Touches whose target and source follow the (collapsed) renames, by one look each."""
    t, s = renames.select(F.col("old_id").alias("target"), F.col("new_id").alias("t2")), renames.select(F.col("old_id").alias("src"), F.col("new_id").alias("s2"))
    out = touches.join(t, "target", "left").join(s, "src", "left")
    return out.select(*[F.coalesce("t2", "target").alias("target") if c == "target" else F.coalesce("s2", "src").alias("src") if c == "src" else F.col(c) for c in touches.columns])

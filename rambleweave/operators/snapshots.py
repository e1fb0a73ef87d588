"""What changed between consecutive full snapshots of a table.

Each row is reduced to its snapshot and 128-bit hashes of its key and of its content. Hash buckets of these are
compared as sorted numpy arrays: searchsorted gives the keys that only one of two consecutive snapshots has and those
whose content differs. Only for these are full values retrieved: the scan drops all other rows by a bitmap of fixed
size before anything is shuffled, the join then removes the few that the bitmap lets through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bitmap import bitmap_of, within_bitmap
from ..plans.durable import cut, shuffle_partitions

BUCKET_ROWS = 1_000_000
FIELDS = ("title", "type", "path", "text", "tags", "aliases", "refs")
_HASH = ["k1", "k2", "r1", "r2"]


def canonical(name: str, is_list: bool) -> Column:
    """A field as it is compared: null as empty, lists in order."""
    if is_list:
        return F.array_sort(F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))).alias(name)
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def compare(pdf: pd.DataFrame, versions: list[int]) -> pd.DataFrame:
    """Rows of a bucket (version, k1, k2, r1, r2) that differ: later, kind (a, d or u), version and the hashes."""
    pdf = pdf.sort_values(["k1", "k2", "version", "r1", "r2"], kind="stable").drop_duplicates(["k1", "k2", "version"])
    k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
    fresh = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]) if len(pdf) else np.zeros(0, bool)
    rank = np.cumsum(fresh)
    of = pdf["version"].to_numpy()
    row = {v: np.flatnonzero(of == v) for v in versions}
    r1, r2 = pdf["r1"].to_numpy(), pdf["r2"].to_numpy()
    out = []

    def absent(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ranks a are not among b, and where they would be."""
        at = np.searchsorted(b, a)
        return (np.append(b, -1)[at] != a), at

    for before, after in zip(versions, versions[1:]):
        a, b = row[before], row[after]
        gone, at = absent(rank[a], rank[b])
        new, _ = absent(rank[b], rank[a])
        both_a, both_b = a[~gone], b[at[~gone]]
        changed = (r1[both_a] != r1[both_b]) | (r2[both_a] != r2[both_b])
        for kind, rows in (("a", b[new]), ("d", a[gone]), ("u", both_a[changed]), ("u", both_b[changed])):
            got = pdf.iloc[rows].copy()
            got["later"], got["kind"] = after, kind
            out.append(got)
    return pd.concat(out)[["later", "kind", "version", *_HASH]]


def snapshot_changes(df: DataFrame, version: str = "snap_no", key: str = "id", fields: tuple[str, ...] = FIELDS, path: str = "path", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows version (the later snapshot), key, kind, detail for each snapshot but the first: 'added', 'deleted' (detail ''), 'renamed' (key: the new one, detail: the old one), 'updated' (one row for each differing field, detail: its name).

    Null equals empty, for strings, lists and what lists hold; lists are compared as multisets; columns outside fields
    do not count. A rename is a vanished and an appeared key of equal text and directory, if no other vanished or
    appeared key shares both and not both keys are all digits. Repeated rows count once; of several different rows of
    a key in one snapshot that with the smallest hash holds; null keys and versions are dropped; the snapshot before is
    the next smaller number there is; one snapshot or none gives no rows. Versions are few and collected.
    """
    versions = sorted(r[0] for r in df.select(version).where(F.col(version).isNotNull()).distinct().collect())
    kinds = dict(df.dtypes)
    if len(versions) < 2:
        return df.sparkSession.createDataFrame([], f"`{version}` {kinds[version]}, `{key}` {kinds[key]}, kind string, detail string")
    lists = {f for f in fields if kinds[f].startswith("array")}
    values = [canonical(f, f in lists) for f in fields]
    rows = df.where(F.col(key).isNotNull() & F.col(version).isNotNull()).select(F.col(version).alias("version"), F.col(key).alias("key"), *values)
    content = [c for f in fields for c in ((F.size(f), F.col(f)) if f in lists else (F.col(f),))]
    hashed = rows.withColumns({"k1": F.xxhash64("key"), "k2": F.xxhash64(F.lit(1), "key"), "r1": F.xxhash64(*content), "r2": F.xxhash64(F.lit(1), *content)})
    compact = cut(hashed.select("version", *_HASH).distinct())
    buckets = max(shuffle_partitions(df.sparkSession), -(-compact.count() // bucket_rows))
    number = kinds[version]
    differing = cut(
        compact.groupBy(F.pmod("k1", F.lit(buckets)).alias("bucket")).applyInPandas(
            lambda pdf: compare(pdf.drop(columns="bucket", errors="ignore"), versions),
            f"later {number}, kind string, version {number}, k1 long, k2 long, r1 long, r2 long",
        )
    )
    # Retrieve values: only of rows that the bitmap of the differing keys lets through.
    place = ["k1", "version"]
    likely = within_bitmap(hashed, place, bitmap_of(differing, place))
    full = likely.select("version", *_HASH, "key", *fields).join(differing, ["version", *_HASH])
    side = F.struct("key", *fields)
    pairs = full.groupBy("later", "kind", "k1", "k2").agg(
        F.max(F.when(F.col("version") < F.col("later"), side)).alias("old"), F.max(F.when(F.col("version") == F.col("later"), side)).alias("new")
    )
    one = F.coalesce("new", "old")
    directory = F.when(F.instr(one[path], "/") > 0, F.regexp_replace(one[path], r"/[^/]*$", "")).otherwise("")
    found = cut(
        pairs.select(
            "later",
            "kind",
            one["key"].alias("key"),
            F.when(F.col("kind") != "u", F.struct(directory.alias("dir"), F.sha2(one[text], 256).alias("sha"))).alias("place"),
            F.when(F.col("kind") == "u", F.filter(F.array(*[F.when(F.col("old")[f] != F.col("new")[f], f) for f in fields]), lambda x: x.isNotNull())).alias("differs"),
        )
    )
    moved = found.where("kind <> 'u'").groupBy("later", "place").agg(
        F.count_if(F.col("kind") == "d").alias("gone"), F.count_if(F.col("kind") == "a").alias("come"),
        F.min(F.when(F.col("kind") == "d", F.col("key"))).alias("old"), F.min(F.when(F.col("kind") == "a", F.col("key"))).alias("new"),
    ).where("gone = 1 and come = 1").where(~(F.col("old").rlike("^[0-9]+$") & F.col("new").rlike("^[0-9]+$")))
    ends = moved.select("later", F.explode(F.array(F.struct(F.lit("d").alias("kind"), F.col("old").alias("key")), F.struct(F.lit("a").alias("kind"), F.col("new").alias("key")))).alias("end")).select("later", "end.*")
    rest = found.where("kind <> 'u'").join(ends, ["later", "kind", "key"], "left_anti")
    named = F.col("later").alias(version), F.col("key").alias(key)
    return (
        moved.select(F.col("later").alias(version), F.col("new").alias(key), F.lit("renamed").alias("kind"), F.col("old").alias("detail"))
        .unionByName(rest.select(*named, F.when(F.col("kind") == "a", "added").otherwise("deleted").alias("kind"), F.lit("").alias("detail")))
        .unionByName(found.where("kind = 'u'").select(*named, F.lit("updated").alias("kind"), F.explode("differs").alias("detail")))
    )


def change_counts(changes: DataFrame, version: str = "snap_no", key: str = "id") -> DataFrame:
    """Changed keys per snapshot and kind."""
    return changes.groupBy(version, "kind").agg(F.countDistinct(key).alias("n"))

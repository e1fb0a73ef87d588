"""References to records that do not exist.

References are first counted per key and period, within the map tasks. Keys that hold more than a given share of all
references are heavy; there can be only so many of them, so they are looked up, and later met again, by broadcast.
The other keys, each once, meet the existing keys in a shuffled anti-join. Only then are the references themselves
read again: the heavy ones without a shuffle, of the others only those that a bitmap of the missing keys, of fixed
size, lets through. Both kinds of orphans are counted by themselves, per key and period, and the counts are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bitmap import bitmap_of, within_bitmap
from ..plans.durable import cut

#: A key is heavy with more than 1/HEAVY_KEYS of all references; so there are fewer heavy keys than this.
HEAVY_KEYS = 2000
_KEY = ["tbl", "scope", "target_key"]


def missing_targets(refs: DataFrame, keys: DataFrame, heavy_keys: int = HEAVY_KEYS) -> tuple[DataFrame, DataFrame]:
    """Of the keys that refs name: the heavy ones, each with missing (true or false), and the other ones that are missing. Columns tbl, scope, target_key."""
    per_period = refs.groupBy(*_KEY, "period").count()
    counted = cut(per_period.groupBy(*_KEY).agg(F.sum("count").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit = total / heavy_keys
    scoped = keys.where("scope is not null").select("tbl", "scope", F.col("key").alias("target_key"))
    anywhere = keys.where("scope is null").select("tbl", F.col("key").alias("target_key"))
    # fewer than heavy_keys rows by the limit itself: proven small
    heavy = F.broadcast(counted.where(F.col("n") > limit).select(*_KEY))
    there = scoped.join(heavy, _KEY, "left_semi").unionByName(heavy.join(anywhere.join(heavy, ["tbl", "target_key"], "left_semi"), ["tbl", "target_key"], "left_semi"))
    checked = cut(heavy.join(there.distinct().withColumn("there", F.lit(True)), _KEY, "left").select(*_KEY, F.col("there").isNull().alias("missing")))
    light = cut(counted.where(F.col("n") <= limit).join(scoped, _KEY, "left_anti").join(anywhere, ["tbl", "target_key"], "left_anti").select(*_KEY))
    return checked, light


def _orphans(refs: DataFrame, keys: DataFrame, heavy_keys: int) -> tuple[DataFrame, DataFrame]:
    """The orphans of heavy keys and of the others."""
    refs = refs.select("tbl", "scope", F.coalesce("period", F.lit("none")).alias("period"), "src_key", "target_key").where("target_key is not null and target_key <> ''")
    heavy, light = missing_targets(refs, keys.where("key is not null"), heavy_keys)
    met = refs.join(F.broadcast(heavy), _KEY, "left")
    likely = within_bitmap(met.where("missing is null").drop("missing"), _KEY, bitmap_of(light, _KEY))
    row = ["tbl", "period", "src_key", "target_key"]
    # light has each key once; a semi-join would be pushed below the bitmap
    return met.where("missing").select(*row).distinct(), likely.join(light, _KEY).select(*row).distinct()


def orphans(refs: DataFrame, keys: DataFrame, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Distinct rows tbl, period, src_key, target_key of refs (tbl, scope, period, src_key, target_key) whose target is no key of keys (tbl, scope, key) of the same tbl and scope; a key without scope exists in every scope.

    Null and empty targets are no references; null keys are no keys; a null period counts as 'none' and a null source
    stays null; repeated rows come out once; without keys all references are orphans, without references there are
    none; other columns are not read.
    """
    heavy, light = _orphans(refs, keys, heavy_keys)
    return heavy.unionByName(light).distinct()


def orphan_counts(refs: DataFrame, keys: DataFrame, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Orphan references per table and period: tbl, period, references, targets. Counted per key and period, of heavy and of other keys apart; a key that is heavy in one scope may be light in another, so both counts of a key are those of different rows only if no row is in two scopes: then it counts once."""
    heavy, light = _orphans(refs, keys, heavy_keys)
    per_key = heavy.unionByName(light).distinct().groupBy("tbl", "period", "target_key").agg(F.count("*").alias("n"))
    return per_key.groupBy("tbl", "period").agg(F.sum("n").alias("references"), F.count("*").alias("targets"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def named_keys(tbl: str, rows: DataFrame, scope: str | None = "") -> DataFrame:
    """The keys by which notes are referred to: id, title and each alias; empty and null names are none. scope: the column that tells it, '' for none in the table, None for keys that exist in every scope."""
    names = F.array_distinct(F.concat(F.array("id", "title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    key = F.explode(F.filter(names, lambda x: x.isNotNull() & (x != ""))).alias("key")
    return rows.select(F.lit(tbl).alias("tbl"), (F.col(scope).cast("string") if scope else F.lit(scope).cast("string")).alias("scope"), key)

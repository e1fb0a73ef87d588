"""All pairs of sets, within a table or between two, that overlap above a similarity.

Values are ordered from rare to frequent. With prefixes that are longer by l - 1, two similar sets share not one but l
values within their prefixes, so they meet on a combination of l values. Each set chooses, in its role as the smaller
set of a pair, the l of least expected work, from the frequencies of its values; as the larger set of a pair it
offers the combinations of every l that a smaller partner may have chosen. That is for pairs whose larger set has fewer
than LARGE values; in others the frequent values are dealt into groups and combined within these, as in texts (see
grams). Sets meet as in meeting, those of a hot combination in blocks. Candidates are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut, shuffle_partitions
from .grams import GRAM_BITS, LEAST_CLASS, LEAST_THRESHOLD, Postings, mix, signatures, slot
from .meeting import HOT, POSTINGS, frequency_table, meet, meet_hot, posting_rows

#: The most values that a small set may ask to share.
MOST_SHARED = 3
#: Pairs whose larger set has so many values or more meet by groups.
LARGE = 1 << LEAST_CLASS
#: What a signature costs by itself, in the unit of a candidate.
SIGNATURE_COST = 0.5
#: Values of sets per bucket.
BUCKET_VALUES = 300_000


def clean_tags(tags: Column) -> Column:
    """Tags as they are compared: trimmed of blanks, without one leading '#', in lower case."""
    return F.transform(tags, lambda t: F.lower(F.regexp_replace(F.trim(t), "^#", "")))


def distinct_values(values: Column) -> Column:
    """The set of a list: without nulls, empty and repeated values."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))


def frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets (column hashes) the values of each slot are, as one byte per slot. Values of a single set count as none."""
    return frequency_table(cut(sets.select(F.explode("hashes").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1")))


def _prefix(size: int, threshold: float, probe: bool) -> int:
    """Values among which a similar partner, at most (probe) or at least as large, has one."""
    need = ceil(threshold * size - 1e-9) if probe else ceil(threshold / (1 + threshold) * 2 * size - 1e-9)
    return size - need + 1


@lru_cache(None)
def _allowed(size: int, threshold: float) -> int:
    """The most values that a smaller set of this size may ask to share: as many as its prefix has to spare."""
    return max(k for k in range(1, MOST_SHARED + 1) if k == 1 or _prefix(size, threshold, False) + k - 1 <= size)


@lru_cache(None)
def _offered(size: int, threshold: float) -> int:
    """The most values that any smaller partner of a set may ask to share."""
    return max(_allowed(s, threshold) for s in range(max(1, ceil(threshold * size - 1e-9)), size + 1))


@lru_cache(None)
def _choose(c: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(c), k)), np.int64).reshape(-1, k)


def _combined(ordered: np.ndarray, length: int, shared: int) -> np.ndarray:
    rows = ordered[_choose(min(length, len(ordered)), shared)]
    rows.sort(axis=1)
    h = np.full(len(rows), shared, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shared):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def set_signatures(values: np.ndarray, frequency: np.ndarray, total: int, threshold: float, probe: bool) -> np.ndarray:
    """Signatures of a set (hashes of its values)."""
    size = len(values)
    level = frequency[slot(values, len(frequency))]
    ordered = values[np.lexsort((values, level))]
    base = _prefix(size, threshold, probe)
    if probe:
        return np.concatenate([_combined(ordered, base + k - 1, k) for k in range(1, _offered(size, threshold) + 1)])
    q = np.sort(level).astype(np.float64)
    df = np.where(q <= 30, q, 30 * 2 ** ((q - 30) / 12))
    best, least = 1, None
    for k in range(1, _allowed(size, threshold) + 1):
        p = df[: min(base + k - 1, size)] / max(1, total)
        expected = total * (np.prod(p[_choose(len(p), k)], axis=1) + SIGNATURE_COST / max(1, total)).sum()
        if least is None or expected < least:
            best, least = k, expected
    return _combined(ordered, base + best - 1, best)


def sets_of(df: DataFrame, key: str, values: Column, least: int) -> tuple[DataFrame, DataFrame]:
    """The distinct sets of a table (d, hashes, members) and which keys have them (key, d). Sets with fewer than least values are left out, as are null keys."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), distinct_values(values).alias("members")).where(F.size("members") >= least)
    rows = cut(rows.distinct())
    # Sets without their keys, each once; the number of a set is fixed by the checkpoint.
    sets = cut(rows.select("members").distinct().select(F.monotonically_increasing_id().alias("d"), "members", F.array_distinct(F.transform("members", lambda x: F.shiftrightunsigned(F.xxhash64(x), 64 - GRAM_BITS))).alias("hashes")))
    return sets, rows.join(sets.select("d", "members"), "members").select("key", "d")


def set_block(sets: list[np.ndarray], frequency: np.ndarray, total: int, threshold: float) -> Postings:
    """Postings of at most 256 sets (hashes of their values). A small set comes twice: with what it chose, as the smaller one of a pair, and with all that it offers, as the larger one."""
    count = np.array([len(x) for x in sets], np.int64)
    large = signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), count), len(sets), frequency, threshold, LEAST_CLASS)
    sig, of, reach, visitor = [large.sig], [large.of], [large.reach], [large.visitor]
    for k in np.flatnonzero((count > 0) & (count < LARGE)).tolist():
        for smaller in (True, False):
            found = set_signatures(sets[k], frequency, total, threshold, not smaller)
            sig.append(found)
            of.append(np.full(len(found), k))
            reach.append(np.full(len(found), min(floor(len(sets[k]) / threshold + 1e-9), LARGE - 1) if smaller else len(sets[k])))
            visitor.append(np.full(len(found), smaller))
    return Postings(*(np.concatenate(x) for x in (sig, of, reach, visitor)), large.size)


def _postings(sets: DataFrame, table: np.ndarray, total: int, threshold: float, buckets: int) -> DataFrame:
    frequency = sets.sparkSession.sparkContext.broadcast(table)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Postings]]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            for k in range(0, len(ids), 256):
                yield ids[k : k + 256], set_block([np.asarray(x, np.int64).view(np.uint64) for x in lists[k : k + 256].to_pylist()], frequency.value, total, threshold)

    return sets.select("d", "hashes").mapInArrow(lambda batches: posting_rows(blocks(batches), threshold, buckets), POSTINGS)


def set_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.6, hot: int = HOT) -> DataFrame:
    """Pairs a, b (numbers d of distinct sets, see sets_of) with similarity of at least threshold: of one table with a < b, or a of left and b of right."""
    if not LEAST_THRESHOLD <= threshold <= 1:
        raise ValueError(f"the threshold must be at least {LEAST_THRESHOLD} and at most 1")
    two = right is not None
    numbered = lambda df, side: df.select((F.col("d") * 2 + side if two else F.col("d")).alias("d"), "hashes", "members")
    both = numbered(left, 0).unionByName(numbered(right, 1)) if two else numbered(left, 0)
    total, values = both.agg(F.count("*"), F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()
    buckets = max(shuffle_partitions(left.sparkSession), -(-values // BUCKET_VALUES))
    met = meet(_postings(both, frequencies(both), total, threshold, buckets).repartitionById(buckets, F.col("bucket")), threshold, hot, two)
    enough = F.max("need").alias("need")
    counted = cut(met.groupBy("l", "s", "sig").agg(F.sum("n").alias("n"), enough).where("sig is not null or n >= need"))
    found, aside = counted.where("sig is null").select("l", "s"), counted.where("sig is not null")
    if not aside.isEmpty():
        crossed = meet_hot(aside.withColumn("g", F.col("l").bitwiseAND(1) if two else F.col("l")), threshold, hot)
        every = met.where("sig is null").select("l", "s", "n", "need").unionByName(crossed)
        found = every.groupBy("l", "s").agg(F.sum("n").alias("n"), enough).where("n >= need").select("l", "s")
    x = both.select(F.col("d").alias("l"), F.col("members").alias("x"))
    y = both.select(F.col("d").alias("s"), F.col("members").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    # Spark can't know the size of a Python map's output and must not choose by it.
    alike = found.hint("merge").join(x, "l").hint("merge").join(y, "s").where(shared >= threshold * (F.size("x") + F.size("y") - shared) - 1e-9)
    if not two:
        return alike.select(F.least("l", "s").alias("a"), F.greatest("l", "s").alias("b"))
    of_side = lambda side: F.shiftright(F.when(F.col("l").bitwiseAND(1) == side, F.col("l")).otherwise(F.col("s")), 1)
    return alike.select(of_side(0).alias("a"), of_side(1).alias("b"))


def similar_within(df: DataFrame, key: str, values: Column, threshold: float = 0.6, least: int = 4) -> DataFrame:
    """All pairs id_a < id_b of keys of a table whose sets are similar (Jaccard of at least threshold).

    Null and empty values are no values, repeated ones count once; null lists are empty; sets of fewer than least
    values and null keys take no part; repeated rows count once; a key with several sets has the pairs of each; an
    empty table gives none; other columns are not read. Equal sets are joined as one and come out as all their pairs.
    """
    sets, owners = sets_of(df, key, values, least)
    owners = cut(owners)
    pairs = set_pairs(sets, None, threshold).unionByName(owners.select(F.col("d").alias("a"), F.col("d").alias("b")).groupBy("a", "b").count().where("count > 1").drop("count"))
    x, y = owners.select(F.col("d").alias("a"), F.col("key").alias("ka")), owners.select(F.col("d").alias("b"), F.col("key").alias("kb"))
    found = pairs.join(x, "a").join(y, "b").where("ka <> kb")
    return found.select(F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).distinct()


def similar_between(left: DataFrame, right: DataFrame, key: str, left_values: Column, right_values: Column, threshold: float = 0.6, least: int = 3) -> DataFrame:
    """All pairs of a key of left and one of right whose sets are similar, as left_id, right_id; otherwise like similar_within."""
    a, owners_a = sets_of(left, key, left_values, least)
    b, owners_b = sets_of(right, key, right_values, least)
    x, y = owners_a.select(F.col("d").alias("a"), F.col("key").alias("left_id")), owners_b.select(F.col("d").alias("b"), F.col("key").alias("right_id"))
    return set_pairs(a, b, threshold).join(x, "a").join(y, "b").select("left_id", "right_id").distinct()


def link_counts(df: DataFrame, key: str, values: Column, threshold: float = 0.6, least: int = 4) -> DataFrame:
    """One row per key that takes part: key, class (smallest key with the same set), links (keys of similar sets). Copies are counted by the size of their class, never expanded."""
    sets, owners = sets_of(df, key, values, least)
    owners = cut(owners)
    size = cut(owners.groupBy("d").agg(F.count("*").alias("n"), F.min("key").alias("class")))
    pairs = set_pairs(sets, None, threshold)
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(size.select(F.col("d").alias("b"), "n"), "b").groupBy(F.col("a").alias("d")).agg(F.sum("n").alias("others"))
    total = size.join(near, "d", "left").select("d", "class", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))
    return owners.join(total, "d").select(F.col("key").alias(key), "class", "links")

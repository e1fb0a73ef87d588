"""Clicks on nodes: a bounded log, counts, and digests of what is new."""

from __future__ import annotations

from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_or_id, utc

KEPT, TOP = 5000, 10


@dataclass(frozen=True)
class TouchConfig:
    digest_count: int = 500
    digest_days: int = 3
    backup_max: int = 5

    @staticmethod
    def parse(text: str | None) -> TouchConfig:
        """From YAML, within the bounds of each value; nothing, or broken YAML, gives the defaults."""
        bounds = {"digest_count": (200, 600), "digest_days": (1, 5), "backup_max": (1, 20)}
        try:
            given = yaml.safe_load(text or "") or {}
            own = {k: min(max(int(given[k]), lo), hi) for k, (lo, hi) in bounds.items() if given.get(k) is not None}
        except (yaml.YAMLError, TypeError, ValueError, AttributeError):
            return TouchConfig()
        return TouchConfig(**own)


def accepted(touches: DataFrame, excluded_files: tuple[str, ...] = (), excluded_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Touches that are recorded: with a target, and none of an excluded name (by name without .md regardless of case, or by its start)."""
    stem = lambda n: F.regexp_replace(n, r"(\.md|\.MD)$", "")
    out = F.lit(False)
    for f in excluded_files:
        out = out | (F.lower(stem(F.col("target"))) == f.removesuffix(".md").removesuffix(".MD").lower())
    for p in excluded_prefixes:
        out = out | F.col("target").startswith(p) if p else out
    return touches.where(F.col("target").isNotNull() & (F.col("target") != "") & ~out)


def last_by_key(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the greatest keys. The bound is found by a top-n, so no task sorts all rows; of equal keys at the bound all stay."""
    if n <= 0:
        return rows.limit(0)
    bound = rows.select(key).where(F.col(key).isNotNull()).orderBy(F.desc(key)).limit(n).agg(F.min(key)).first()[0]
    return rows.limit(0) if bound is None else rows.where(F.col(key) >= bound)


def append(log: DataFrame, new: DataFrame, kept: int = KEPT) -> DataFrame:
    """The log with new touches (ts, target, src), numbered on from its last seq in the order of ts, target, src; then its last `kept` rows."""
    last = log.agg(F.max("seq")).first()[0] or 0
    numbered = new.select(F.row_number().over(Window.orderBy("ts", "target", "src")).cast("long").alias("k"), "ts", "target", "src")  # one request's touches
    return last_by_key(log.select("seq", "ts", "target", "src").unionByName(numbered.select((F.col("k") + last).alias("seq"), "ts", "target", "src")), "seq", kept)


def _top(touches: DataFrame, column: str, n: int) -> DataFrame:
    named = touches.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return named.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "id").limit(n)


def top_targets(touches: DataFrame, docs: DataFrame, n: int = TOP) -> DataFrame:
    """id, title, count of the most touched targets that are documents. Counted before it is joined, so a hot target is one row by then."""
    counts = touches.where("target <> ''").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("count"))
    return counts.join(docs.select("id", title_or_id(F.col("title"), F.col("id")).alias("title")), "id").orderBy(F.desc("count"), "id").limit(n).select("id", "title", "count")


def top_sources(touches: DataFrame, n: int = TOP) -> DataFrame:
    """id, count of the most frequent sources, whatever they are."""
    return _top(touches, "src", n)


def touch_stats(touches: DataFrame, docs: DataFrame) -> DataFrame:
    """part, place, id, count: 'total' (one row, with touches of targets that don't exist), 'target' and 'source' rows by place."""
    placed = lambda df, part: df.select(F.lit(part).alias("part"), F.row_number().over(Window.orderBy(F.desc("count"), "id")).alias("place"), "id", "count")  # noqa: E731  # ten rows
    total = touches.agg(F.count("*").alias("count")).select(F.lit("total").alias("part"), F.lit(1).alias("place"), F.lit("").alias("id"), "count")
    return total.unionByName(placed(top_targets(touches, docs), "target")).unionByName(placed(top_sources(touches), "source"))


def touch_count(touches: DataFrame) -> DataFrame:
    return touches.agg(F.count("*").alias("n"))


def digest_due(now: int, last_seq: int, last_ts: int | None, seq: int, config: TouchConfig) -> bool:
    """Whether a digest is to be made: enough touches since the last one, or (if there was one) days enough."""
    if not seq:
        return False
    return seq - last_seq >= config.digest_count or bool(last_ts) and now - last_ts >= config.digest_days * 86400


def digest(touches: DataFrame, docs: DataFrame, since_seq: int, window_start: int) -> DataFrame:
    """One row for the touches after since_seq: window_start, since, total, targets (structs id, title, count), sources (id, count)."""
    new = touches.where(F.col("seq") > since_seq)
    listed = lambda df, *c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), *c))), lambda x: F.struct(*[x[n].alias(n) for n in c]))
    one = lambda df: df.withColumn("_", F.lit(1))
    total = new.agg(F.count("*").alias("total"))
    targets = top_targets(new, docs).agg(listed(None, "id", "title", "count").alias("targets"))
    sources = top_sources(new).agg(listed(None, "id", "count").alias("sources"))
    rows = one(total).join(one(targets), "_").join(one(sources), "_").drop("_")
    return rows.select(F.lit(window_start).cast("long").alias("window_start"), F.date_format(utc(F.lit(window_start)), "yyyy-MM-dd HH:mm").alias("since"), "total", "targets", "sources")

"""Digests over a stream of touches, kept in state across batches.

Time is processing time only: a digest is due by the number of touches since the last one, or by days since it, which a
timer watches though no touch comes.
"""

from __future__ import annotations

import heapq
import json
import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.touches import KEPT, TOP, TouchConfig, append, digest_due, last_by_key, touch_stats
from ..schema import TOUCH
from ..sources.sheet import Sheet

OUTPUT = "stream string, digest_no long, generated_at long, window_start long, total long, targets string, sources string"


#: Touches counted together before they go to the one task of their stream.
PARTIAL = "stream string, target string, src string, n long"


def partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within the tasks that read touches: how often each pair of target and source comes."""
    for pdf in batches:
        yield pdf.fillna("").groupby(["stream", "target", "src"], sort=False).size().rename("n").reset_index()


class _Digests(StatefulProcessor):
    """Of each stream key: the count and time of the last digest, and counts of targets and sources since. A timer makes a digest that is due by the days alone."""

    def __init__(self, config: TouchConfig, clock: int | None):
        self.config, self.clock = config, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", "seq long, last_seq long, last_ts long, digests long")
        self.targets = handle.getMapState("targets", "id string", "n long")
        self.sources = handle.getMapState("sources", "id string", "n long")

    def _add(self, state: object, counts: dict[str, int]) -> None:
        for name, n in counts.items():
            key = (name,)
            had = state.getValue(key)[0] if state.containsKey(key) else 0
            state.updateValue(key, (int(had + n),))

    def _top(self, counts: Iterable[tuple[str, int]]) -> str:
        rows = heapq.nsmallest(TOP, ((-n, k) for k, n in counts))
        return json.dumps([{"id": k, "count": -n} for n, k in rows], ensure_ascii=False)

    def _digest(self, key: tuple, now: int, meta: tuple, held: tuple[dict, dict] | None = None) -> tuple[tuple, tuple]:
        """A digest's row, and what is kept after it. held: all counts of targets and sources, if none are in state."""
        seq, last_seq, last_ts, digests = meta
        if held is not None:
            tops = [self._top(c.items()) for c in held]
        else:
            tops = [self._top((k[0], v[0]) for k, v in state.iterator()) for state in (self.targets, self.sources)]
            self.targets.clear()
            self.sources.clear()
        return (key[0], digests + 1, now, last_ts or now, seq - last_seq, *tops), (seq, seq, now, digests + 1)

    def _rows(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["stream", "digest_no", "generated_at", "window_start", "total", "targets", "sources"])

    def _wake(self, last_ts: int) -> None:
        """One timer: when the days since the last digest are over."""
        if self.clock is None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((last_ts + self.config.digest_days * 86400) * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = self.clock if self.clock is not None else int(time.time())
        meta = tuple(self.meta.get()) if self.meta.exists() else (0, 0, 0, 0)
        before, out = meta[3], []
        held: tuple[dict, dict] = ({}, {})
        # State costs a call for each name; it is only needed for what a batch leaves to the next.
        kept = meta[0] > meta[1]

        def store() -> None:
            for state, counts in zip((self.targets, self.sources), held):
                self._add(state, counts)
                counts.clear()

        for pdf in rows:
            for target, src, n in zip(pdf["target"], pdf["src"], pdf["n"].tolist()):
                # A pair may come more often than there is room up to the next digest.
                while n:
                    seq, last_seq, last_ts, digests = meta
                    part = min(n, max(1, self.config.digest_count - (seq - last_seq)))
                    n, meta = n - part, (seq + part, last_seq, last_ts, digests)
                    for counts, name in zip(held, (target, src)):
                        if name:
                            counts[name] = counts.get(name, 0) + part
                    if digest_due(now, last_seq, last_ts or None, meta[0], self.config):
                        if kept:
                            store()
                        row, meta = self._digest(key, now, meta, None if kept else held)
                        out.append(row)
                        kept = False
                        for counts in held:
                            counts.clear()
        store()
        self.meta.update(meta)
        if meta[3] > before:
            self._wake(now)
        yield from self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now, meta = int(time.time()), tuple(self.meta.get())
        if digest_due(now, meta[1], meta[2] or None, meta[0], self.config):
            row, meta = self._digest(key, now, meta)
            self.meta.update(meta)
            yield from self._rows([row])
        self._wake(meta[2])

    def close(self) -> None:
        pass


def digest_stream(touches: DataFrame, config: TouchConfig = TouchConfig(), stream: str | None = None, clock: int | None = None) -> DataFrame:
    """A streaming frame of digests (see OUTPUT) of streaming touches (target, src). stream: a column that keeps vaults apart; clock: a fixed time, for tests, which also leaves the timer out. It needs the RocksDB state store.

    A stream is one task's, as a digest falls due by the count of all its touches; it gets them counted by pairs of target and source.
    """
    keyed = touches.select(F.coalesce(F.col(stream), F.lit("")).alias("stream") if stream else F.lit("").alias("stream"), "target", "src").mapInPandas(partial_counts, PARTIAL)
    return keyed.groupBy("stream").transformWithStateInPandas(statefulProcessor=_Digests(config, clock), outputStructType=OUTPUT, outputMode="append", timeMode="none" if clock is not None else "processingTime")


def existing_targets(digests: DataFrame, docs: DataFrame) -> DataFrame:
    """Digests (of a batch or stream) with one row per target that is a document, with its title."""
    each = digests.withColumn("t", F.explode(F.from_json("targets", "array<struct<id string, count long>>"))).select("stream", "digest_no", F.col("t.id").alias("id"), F.col("t.count").alias("count"))
    return each.join(docs.select("id", "title"), "id")


def keep_log(path: str, kept: int = KEPT):  # noqa: ANN201
    """A foreachBatch function that appends touches (seq, ts, target, src) to a table of two generations and trims it to the last ones; the same batch twice makes no difference."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = sorted((int(s.getPath().getName()[1:]) for s in fs.listStatus(hadoop(path)) if s.getPath().getName().startswith("b")), reverse=True) if fs.exists(hadoop(path)) else []
        old = next((n for n in before if n < number), None)
        rows = batch.select("seq", "ts", "target", "src")
        if old is not None:
            rows = rows.unionByName(spark.read.parquet(f"{path}/b{old}"))
        last_by_key(rows, "seq", kept).write.mode("overwrite").parquet(f"{path}/b{number}")
        for n in before:
            if n < number and n != old:
                fs.delete(hadoop(f"{path}/b{n}"), True)

    return write


def read_log(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The newest generation of a log."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()[1:]) for s in fs.listStatus(hadoop(path)) if s.getPath().getName().startswith("b"))
    return spark.read.parquet(f"{path}/b{last}")


class DigestBook:
    """Digests made from a log in batches: what was last made, what was acknowledged, and the latest target lists. With a sheet of facts all of that outlives the process."""

    def __init__(self, config: TouchConfig = TouchConfig(), sheet: Sheet | None = None):
        self.config, self.sheet = config, sheet
        self.last_seq, self.last_ts, self.last, self.acknowledged = 0, None, None, None
        self.backups: dict[str, list] = {}
        if sheet is not None and (known := sheet.facts().get("digests")):
            self.last_seq, self.last_ts, self.last, self.acknowledged, self.backups = known

    def _keep(self) -> None:
        if self.sheet is not None:
            self.sheet.put(digests=[self.last_seq, self.last_ts, self.last, self.acknowledged, self.backups])

    def maybe(self, touches: DataFrame, docs: DataFrame, now: int) -> dict | None:
        """A digest if one is due. The first one's window begins now; one made by the days alone may be empty."""
        from ..operators.touches import digest

        seq = touches.agg(F.max("seq")).first()[0] or 0
        if not digest_due(now, self.last_seq, self.last_ts, seq, self.config):
            return None
        row = digest(touches, docs, self.last_seq, self.last_ts or now).first().asDict(recursive=True)  # twenty names
        number = f"{now}-{seq}"
        self.last = {"id": number, "generated_at": now, **row}
        self.last_seq, self.last_ts = seq, now
        self.backups[number] = row["targets"]
        while len(self.backups) > self.config.backup_max:
            self.backups.pop(next(iter(self.backups)))
        self._keep()
        return self.last

    def latest(self) -> dict | None:
        return self.last

    def available(self) -> bool:
        return bool(self.last) and self.last["id"] != self.acknowledged

    def acknowledge(self, number: str | None = None) -> None:
        """Mark a digest, by its id, or else the last one as read."""
        if number or self.last:
            self.acknowledged = number or self.last["id"]
            self._keep()


class TouchLog(Sheet):
    """A collection's touches in a folder that all executors reach: the last ones, their statistics and their digests. One generation per append; the one before stays."""

    def __init__(self, spark: SparkSession, path: str, docs: DataFrame, config: TouchConfig = TouchConfig(), kept: int = KEPT):
        super().__init__(spark, path)
        self.docs, self.kept, self.book = docs, kept, DigestBook(config, self)

    def touches(self) -> DataFrame:
        number = self.facts().get("touches")
        return self.spark.createDataFrame([], TOUCH) if number is None else self.spark.read.parquet(f"{self.path}/touches-{number}")

    def touch(self, new: DataFrame) -> None:
        """Append touches (ts, target, src)."""
        number = self.facts().get("touches", -1) + 1
        append(self.touches(), new, self.kept).write.mode("overwrite").parquet(f"{self.path}/touches-{number}")
        self.put(touches=number)
        if number > 1:
            self.delete(f"touches-{number - 2}")

    def stats(self) -> DataFrame:
        return touch_stats(self.touches(), self.docs)

    def digest(self, now: int) -> dict | None:
        return self.book.maybe(self.touches(), self.docs, now)

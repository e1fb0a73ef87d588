"""Noticing that a vault changed, and swapping in a graph of its new state."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import LinkGraph
from ..plans.durable import cut
from ..sources.markdown import vault_files
from ..sources.profile import FOLDER, Profile

POLL, THROTTLE = 10.0, 60.0
#: Folders whose changes never count.
QUIET_DIRS = [FOLDER, ".git", ".obsidian", ".trash", ".dsh", ".agents"]


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, kind (added, deleted, changed) between two listings (path, mtime, size)."""
    b, a = before.select("path", F.struct("mtime", "size").alias("b")), after.select("path", F.struct("mtime", "size").alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "path", "full_outer").select("path", kind.alias("kind")).where("kind is not null")


class VaultChecker:
    """Whether files of a vault were added, deleted or changed since the last call; the first call finds them all new. Only listings are read, no contents; the last one is kept in the checkpoint folder and compared by a join."""

    def __init__(self, spark: SparkSession, root: str, profile: Profile):
        self.spark, self.root = spark, root
        self.profile = profile.with_excluded_dirs(QUIET_DIRS)
        self.last: DataFrame | None = None

    def __call__(self) -> bool:
        now = vault_files(self.spark, self.root, self.profile).select("path", "mtime", "size")
        if self.last is not None and file_changes(self.last, now).isEmpty():
            return False
        first, self.last = self.last is None, cut(now)
        return not (first and self.last.isEmpty())


class FileChecker:
    """Whether a file's time or size changed; the first call says yes."""

    def __init__(self, path: str):
        self.path, self.last = path, None

    def __call__(self) -> bool:
        s = os.stat(self.path)
        now = (s.st_mtime_ns, s.st_size)
        changed, self.last = now != self.last, now
        return changed


class Watch:
    """Polls, and refreshes at most once per throttle time. What failed stays pending."""

    def __init__(self, check: Callable[[], bool], refresh: Callable[[], None], throttle: float = THROTTLE, clock: Callable[[], float] = time.monotonic):
        self.check, self.refresh, self.throttle, self.clock = check, refresh, throttle, clock
        self.pending, self.last = False, float("-inf")

    def step(self) -> bool:
        """One poll; whether it refreshed."""
        try:
            self.pending |= bool(self.check())
        except Exception:  # noqa: BLE001 - a vault that cannot be read now is tried again
            return False
        if not self.pending or self.clock() - self.last < self.throttle:
            return False
        try:
            self.refresh()
        except Exception:  # noqa: BLE001
            return False
        self.pending, self.last = False, self.clock()
        return True

    def run(self, stop: threading.Event, poll: float = POLL) -> None:
        while not stop.wait(poll):
            self.step()


class GraphHolder:
    """The current graph; replacing it raises the revision and lets go of what the old one kept."""

    def __init__(self, graph: LinkGraph | None = None):
        self._lock = threading.Lock()
        self.graph, self.revision = graph, 0

    def replace(self, graph: LinkGraph) -> int:
        with self._lock:
            old, self.graph = self.graph, graph
            self.revision += 1
        if old is not None:
            for name in ("edges", "nodes", "_named"):
                if name in old.__dict__:
                    old.__dict__[name].unpersist()
        return self.revision

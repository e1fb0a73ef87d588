"""The engine's own store: documents without references, their directed links, renames, and a small sheet of facts.

Each save writes a new generation beside the current one and then a new sheet of facts that points to it, by one rename
(see sheet), so a reader never sees half a state and a failed save changes nothing. Saving what is there already
writes nothing.
"""

from __future__ import annotations

import hashlib
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, DOCUMENTS, LINKS, RENAMES
from .profile import FOLDER, Profile
from .sheet import Sheet

PARSER_VERSION = 1


def store_path(source: str, prefix: str = "graph") -> str:
    """Where a source's store is: in a folder of the vault (or beside a database file), by a hash of its clean path."""
    clean = posixpath.normpath(source.replace("\\", "/"))
    home = os.path.dirname(clean) if clean.lower().endswith(".db") else clean
    return os.path.join(home, FOLDER, f"{prefix}-{hashlib.sha256(clean.encode()).hexdigest()[:12]}")


class Store(Sheet):
    """path: a folder that all executors reach."""

    def stale(self, profile: Profile) -> bool:
        """Whether documents must be parsed anew: written by another parser or under another profile."""
        facts = self.facts()
        return facts.get("parser_version") != PARSER_VERSION or facts.get("profile") != profile.signature()

    # -- documents -----------------------------------------------------------
    def load(self) -> DataFrame:
        """The documents, with references in the order of their targets; none if nothing was saved."""
        number = self.facts().get("documents")
        if number is None:
            return self.spark.createDataFrame([], DOCUMENTS)
        docs, links = (self.spark.read.parquet(f"{self.path}/{t}-{number}") for t in ("docs", "links"))
        refs = links.groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_list("b")).alias("refs"))
        return docs.join(refs, "id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>"))).select(*COLUMNS)

    def save(self, docs: DataFrame) -> dict[str, int]:
        """Write documents if they differ from what is there; gives the numbers of documents put and deleted. Links are distinct, those of a document to itself are left out; times are kept to the second."""
        rows = docs.withColumn("mtime", F.date_trunc("second", "mtime"))
        links = rows.select(F.col("id").alias("a"), F.explode("refs").alias("b")).where("a <> b").distinct()
        rest = [c for c in COLUMNS if c not in ("id", "refs")]
        stored = self.load()
        shape = lambda df, name: df.select("id", F.struct(*rest, F.array_sort(F.array_distinct(F.filter("refs", lambda r: r != F.col("id")))).alias("refs")).alias(name))
        both = shape(stored, "old").join(shape(rows, "new"), "id", "full_outer")
        put, gone = both.agg(F.count_if(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))), F.count_if(F.col("new").isNull())).first()
        facts = self.facts()
        if put or gone or "documents" not in facts:
            number = facts.get("documents", -1) + 1
            rows.drop("refs").write.mode("overwrite").parquet(f"{self.path}/docs-{number}")
            links.write.mode("overwrite").parquet(f"{self.path}/links-{number}")
            self.put(documents=number)
            if number > 1:  # the one before stays for readers that still have it
                for t in ("docs", "links"):
                    self.delete(f"{t}-{number - 2}")
        return {"put": put, "deleted": gone}

    def links(self) -> DataFrame:
        number = self.facts().get("documents")
        return self.spark.createDataFrame([], LINKS) if number is None else self.spark.read.parquet(f"{self.path}/links-{number}")

    # -- renames -----------------------------------------------------------------
    def renames(self) -> DataFrame:
        number = self.facts().get("renames")
        return self.spark.createDataFrame([], RENAMES) if number is None else self.spark.read.parquet(f"{self.path}/renames-{number}")

    def save_renames(self, renames: DataFrame) -> None:
        number = self.facts().get("renames", -1) + 1
        renames.select("old_id", "new_id").write.mode("overwrite").parquet(f"{self.path}/renames-{number}")
        self.put(renames=number)
        if number > 1:
            self.delete(f"renames-{number - 2}")

"""Outliner blocks as documents: a SQLite file, or tables of the same shape.

A document is a page (a block without content) or the top block of a chain without a page. Everything below that is
no page belongs to it. Owners are the roots that the hierarchy operator finds where pages end the chains of parents, and
the order of texts comes from its paths, which reach no further than that.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import trimmed
from ..operators.forest import hierarchy
from ..plans.durable import cut, local_folder
from ..schema import BLOCK, BLOCK_ALIAS, BLOCK_REF, COLUMNS

#: The only tables that are ever read, and how. Others may hold credentials.
_TABLES = {
    "Block": ("rowid, id, content, text, modified, parent, \"left\"", BLOCK),
    "BlockAlias": ("rowid, name, block, pos", BLOCK_ALIAS),
    "BlockRef": ("rowid, f, t", BLOCK_REF),
}
ROWS_PER_PARTITION = 200_000
#: Up to so many blocks the hierarchy is one fragment.
ONE_TASK = 100_000


def is_block_db(path: str) -> bool:
    return path.lower().endswith(".db")


def snapshot(path: str, folder: str) -> str:
    """A consistent copy of a database that may be in use, made by SQLite's own backup, in a folder that all executors share; the caller removes it."""
    to = os.path.join(folder, f"snapshot-{uuid.uuid4().hex}.db")
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=10) as a, sqlite3.connect(to) as b:
            a.create_function("to_pinyin", 1, lambda x: x, deterministic=True)
            a.backup(b)
    except sqlite3.Error:
        for end in ("-wal", "-shm", ""):  # locked: copy the files, the log first, and see whether they fit
            if os.path.exists(path + end):
                shutil.copyfile(path + end, to + end)
        with sqlite3.connect(to) as b:
            if b.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
                raise OSError(f"{path} cannot be read consistently") from None
    return to


@dataclass
class _Rows(InputPartition):
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[_Rows]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if low is None:
            return [_Rows(0, -1)]
        return [_Rows(a, min(a + ROWS_PER_PARTITION - 1, high)) for a in range(low, high + 1, ROWS_PER_PARTITION)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        columns = _TABLES[self.table][0]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f"SELECT {columns} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (part.first, part.last)):
                yield tuple(row[1:])


class BlockDatabase(DataSource):
    """Reads one of the allowed tables of a block database: options path and table."""

    @classmethod
    def name(cls) -> str:
        return "block_database"

    def schema(self) -> str:
        if self.options["table"] not in _TABLES:
            raise ValueError(f"{self.options['table']} is not among {[*_TABLES]}")
        return _TABLES[self.options["table"]][1]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"])


def read_block_tables(spark: SparkSession, path: str, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, aliases and references of a snapshot of a database, read into the checkpoint folder; the snapshot is removed. On a cluster, folder must be one that all executors share."""
    spark.dataSource.register(BlockDatabase)
    own = None if folder else local_folder(spark, "rambleweave-blocks-", "name a shared one as folder")
    copy = snapshot(path, folder or own)
    read = lambda t: spark.read.format("block_database").option("path", copy).option("table", t).load()
    try:
        return cut(read("Block")), cut(read("BlockAlias")), cut(read("BlockRef"))
    finally:
        shutil.rmtree(own) if own else os.remove(copy)


def title_from(text: Column) -> Column:
    """The first line of a text without leading #, up to ' #', at most 30 characters."""
    line = trimmed(F.regexp_replace(trimmed(text), r"(?s)\n.*$", ""))
    bare = trimmed(F.regexp_replace(line, "^#+", ""))
    short = F.when(F.instr(bare, " #") > 1, F.substring_index(bare, " #", 1)).otherwise(bare)
    return F.nullif(trimmed(F.substring(trimmed(short), 1, 30)), F.lit(""))


def block_documents(blocks: DataFrame, aliases: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents of blocks (id, content, text, modified, parent, left_id), aliases (name, block, pos) and refs (f, t).

    text: the document's own text, then those of its blocks in the order of the outline (by left, null as 0, then id,
    depth first), joined without a separator and trimmed; nested pages keep theirs and are referred to. References of
    any block count for its document and lead to the target's document; those to itself or to nothing are dropped. A
    document without text and alias is left out, or is a container if it refers to something. Blocks on or below a
    cycle of parents belong to no document. Repeated rows count once.
    """
    b = blocks.select("id", "content", "text", F.col("modified").cast("long").alias("modified"), "parent", F.coalesce("left_id", F.lit(0)).cast("long").alias("left")).where("id is not null")
    b = b.groupBy("id").agg(F.max(F.struct("content", "text", "modified", "parent", "left")).alias("r")).select("id", "r.*").withColumn("page", F.col("content").isNull())
    # Pages end the chains: the root of a block is then its owner, and the way from there needs no page above it.
    inner = hierarchy(b.select("id", F.when(~F.col("page"), F.col("parent")).alias("parent")), with_path=True, one_task=ONE_TASK).where("kind = 'tree'").select("id", F.col("root_id").alias("owner"), "path")
    # Owners hang on each other by their parents' owners; what is on or below a cycle of pages falls out, as does what hangs below a cycle of blocks.
    roots = inner.where("id = owner").select("id").join(b.select("id", "parent"), "id")
    above = inner.select(F.col("id").alias("parent"), F.col("owner").alias("up"))
    known = b.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    hung = roots.join(above, "parent", "left").join(known, "parent", "left").select("id", F.coalesce("up", F.when(F.col("there"), F.col("id"))).alias("parent"))
    sound = hierarchy(hung, one_task=ONE_TASK).where("kind = 'tree'").select(F.col("id").alias("owner"))
    inner = inner.join(sound, "owner", "left_semi")
    # The place of a block in its document: left and id of every block on the way from the owner, which itself is left out.
    each = inner.where("id <> owner").select("id", F.posexplode(F.slice("path", 2, F.size("path"))).alias("depth", "up"))
    placed = each.join(b.select(F.col("id").alias("up"), "left"), "up").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("depth", "left", "up"))).alias("way"))
    place = F.coalesce(F.transform("way", lambda x: F.struct(x["left"].alias("left"), x["up"].alias("up"))), F.array().cast("array<struct<left: bigint, up: bigint>>"))
    owned = cut(inner.select("id", "owner").join(placed, "id", "left").select("id", "owner", place.alias("place")))
    rows = owned.join(b, "id")
    blank = lambda c: F.coalesce(trimmed(c), F.lit("")) == ""
    own = F.when(~blank(F.col("text")), F.col("text")).otherwise("")
    texts = rows.groupBy("owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", own.alias("text")))), lambda x: x["text"]), "").alias("joined"),
        F.min(F.when((F.size("place") == 1) & title_from(F.col("text")).isNotNull(), F.struct("place", title_from(F.col("text")).alias("title")))).alias("kid"),
    )
    owner = owned.select("id", "owner")
    linked = refs.where("f is not null and t is not null").select("f", "t").distinct()
    linked = linked.join(owner.select(F.col("id").alias("f"), F.col("owner").alias("a")), "f").join(owner.select(F.col("id").alias("t"), F.col("owner").alias("b")), "t").select("a", "b")
    above = b.where(F.col("page") & F.col("parent").isNotNull()).select("parent", F.col("id").alias("b")).join(owner.select(F.col("id").alias("parent"), F.col("owner").alias("a")), "parent").select("a", "b")
    links = linked.union(above).where("a <> b").distinct()
    names = aliases.where("block is not null and name is not null").select("block", "pos", "name").distinct().groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("aliases"))
    root = rows.where("id = owner").select("id", "page", "text", "modified")
    told = root.join(texts.withColumnRenamed("owner", "id"), "id").join(names.withColumnRenamed("block", "id"), "id", "left")
    told = told.withColumn("body", trimmed(F.col("joined"))).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    told = told.join(links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    empty = (F.col("body") == "") & (F.size("aliases") == 0)
    shells = told.where(empty & F.col("n").isNull()).select(F.col("id").alias("b"))
    kept = links.join(shells, "b", "left_anti").groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_list(F.col("b").cast("string"))).alias("refs"))
    shown = told.where(~(empty & F.col("n").isNull())).join(kept, "id", "left")
    key = F.col("id").cast("string")
    plain = F.when(F.col("page"), F.concat(F.lit("页面#"), key)).otherwise(F.concat(F.lit("块#"), key))
    title = F.coalesce(F.nullif(trimmed(F.try_element_at("aliases", F.lit(1))), F.lit("")), title_from(F.col("text")), F.col("kid.title"), plain)
    return shown.select(
        key.alias("id"),
        F.when(empty, F.concat(F.lit("容器#"), key)).otherwise(title).alias("title"),
        "aliases",
        F.when(empty, "container").when(F.col("page"), "doc").otherwise("block").alias("type"),
        F.concat(F.lit("block/"), key).alias("path"),
        F.timestamp_seconds("modified").alias("mtime"),
        F.octet_length("body").cast("long").alias("size"),
        F.coalesce("refs", F.array().cast("array<string>")).alias("refs"),
        F.array().cast("array<string>").alias("tags"),
        F.col("body").alias("text"),
    ).select(*COLUMNS)


def read_block_db(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    return block_documents(*read_block_tables(spark, path, folder))

"""The link graph of documents: which reference leads where, edges, degrees, statistics.

The graph is undirected and simple. A reference is taken as an id, else as a title, else as an alias (the smallest id
of that name); what it becomes is kept in the ledger: self, redirect_self, dangling, edge, or multi for an edge that
is there already.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_list
from ..plans.durable import shuffle_partitions
from ..schema import COLUMNS, DOCUMENTS
from .components import components


def documents(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the shape of documents: columns that are missing are added as null, null strings and lists become empty, lists lose null and empty elements, rows without id are dropped, and of several rows of an id the one of the greatest path, time and size holds (column by column, so that columns nobody asks for are never read). by: columns, such as a snapshot's number, that are kept and within whose values each id counts once."""
    kinds = {f.name: f.dataType for f in DOCUMENTS.fields}
    have = set(df.columns)
    column = lambda c: F.col(c) if c in have else F.lit(None)

    def value(c: str) -> Column:
        if kinds[c].typeName() == "array":
            return clean_list(column(c).cast("array<string>")).alias(c)
        if kinds[c].typeName() == "string":
            return F.coalesce(column(c).cast("string"), F.lit("")).alias(c)
        return column(c).cast(kinds[c]).alias(c)

    rows = df.where(F.col("id").isNotNull()).select(*by, *[value(c) for c in COLUMNS])
    rest = [c for c in COLUMNS if c != "id"]
    order = F.struct("path", "mtime", "size")
    return rows.groupBy(*by, "id").agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*by, *COLUMNS)


def name_index(docs: DataFrame) -> DataFrame:
    """name, target: ids before titles before aliases, the smallest id of equals; empty names are none."""
    own = docs.select(
        F.col("id").alias("target"),
        F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("id").alias("name")), F.struct(F.lit(1).alias("rank"), F.col("title").alias("name"))), F.transform("aliases", lambda a: F.struct(F.lit(2).alias("rank"), a.alias("name"))))).alias("n"),
    )
    return own.where("n.name <> ''").groupBy(F.col("n.name").alias("name")).agg(F.min(F.struct("n.rank", "target"))["target"].alias("target"))


class LinkGraph:
    """A graph over documents; its tables are plans, computed when they are used. structural: types that are left out of results."""

    def __init__(self, docs: DataFrame, structural: tuple[str, ...] = ("container",), renames: DataFrame | None = None):
        self.docs = docs
        self.structural = tuple(structural)
        self.renames = renames

    @cached_property
    def _named(self) -> DataFrame:
        """The columns of docs that the graph is made of, kept: its steps ask for different ones, for each of which rows of equal ids would be put together anew."""
        return self.docs.select("id", "title", "type", "aliases", "refs").persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def _kinds(self) -> DataFrame:
        """src, pos, ref, target, kind of every reference, where a kind of null is an edge, be it the first of its pair or not."""
        from .reconcile import redirected

        docs = redirected(self.docs, self.renames) if self.renames is not None else self._named
        refs = docs.select(F.col("id").alias("src"), F.posexplode("refs").alias("pos", "ref"))
        met = refs.join(name_index(self._named), refs["ref"] == F.col("name"), "left").drop("name")
        plain = F.when(F.col("ref") == F.col("src"), "self").when(F.col("target").isNull(), "dangling").when(F.col("target") == F.col("src"), "redirect_self")
        return met.withColumn("kind", plain)

    @cached_property
    def ledger(self) -> DataFrame:
        """src, pos, ref, target, kind of every reference."""
        kinds = self._kinds
        pair = Window.partitionBy(F.least("src", "target"), F.greatest("src", "target")).orderBy("src", "pos")
        linked = kinds.where("kind is null").withColumn("kind", F.when(F.row_number().over(pair) == 1, "edge").otherwise("multi"))
        return kinds.where("kind is not null").unionByName(linked)

    @cached_property
    def edges(self) -> DataFrame:
        """src, dst in both directions, each once; kept partitioned by src, so steps along edges only move what is at their ends. Which reference of a pair came first is not asked: the pairs of the ledger's edges are all pairs, found by one shuffle."""
        e = self._kinds.where("kind is null").select("src", F.col("target").alias("dst"))
        both = e.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst")
        return both.repartition(shuffle_partitions(both.sparkSession), "src").distinct().persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def nodes(self) -> DataFrame:
        """id, title, type, deg of every document."""
        deg = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("int").alias("deg"))
        return self._named.select("id", "title", "type").join(deg, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0))).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def size(self) -> int:
        return self.nodes.count()

    @cached_property
    def edge_count(self) -> int:
        return self.edges.count()

    @property
    def hub_degree(self) -> int:
        """From this degree on a node is a hub."""
        return self.size // 2

    def is_hub(self, deg: str = "deg") -> Column:
        return F.col(deg) >= self.hub_degree

    def is_structural(self, kind: str = "type") -> Column:
        return F.col(kind).isin(*self.structural) if self.structural else F.lit(False)

    def presentable(self) -> Column:
        """Nodes that may be offered: with a title, linked, neither hub nor structural."""
        return (F.col("title") != "") & (F.col("deg") > 0) & ~self.is_hub() & ~self.is_structural()

    def neighbours(self, key: str) -> DataFrame:
        return self.edges.where(F.col("src") == key).select(F.col("dst").alias("id")).join(self.nodes, "id")

    def dangling(self) -> DataFrame:
        """source, target of each dangling reference."""
        return self.ledger.where("kind = 'dangling'").select(F.col("src").alias("source"), F.col("ref").alias("target"))

    def component_of(self) -> DataFrame:
        """id, component for every node; an isolated node is a component of its own."""
        found = components(self.edges, "src", "dst")
        return self.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def stats(self) -> DataFrame:
        """One row: nodes, edges, total_links, self_links, multi_edge, dangling_kinds, dangling_links, orphans, components, top_hubs (ids, by degree, ten at most)."""
        links = self.ledger.agg(
            F.count("*").alias("total_links"), F.count_if(F.col("kind") == "self").alias("self_links"), F.count_if(F.col("kind") == "multi").alias("multi_edge"),
            F.countDistinct(F.when(F.col("kind") == "dangling", F.col("ref"))).alias("dangling_kinds"), F.count_if(F.col("kind") == "dangling").alias("dangling_links"),
        )
        own = self.nodes.agg(F.count("*").alias("nodes"), (F.coalesce(F.sum("deg"), F.lit(0)) / 2).cast("long").alias("edges"), F.count_if(F.col("deg") == 0).alias("orphans"))
        parts = self.component_of().agg(F.countDistinct("component").alias("components"))
        top = self.hubs(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("deg")).alias("k"), "id"))), lambda x: x["id"]), "|").alias("top_hubs"))
        one = lambda df: df.withColumn("_", F.lit(1))
        # four tables of one row each
        return one(own).join(one(links), "_").join(one(parts), "_").join(one(top), "_").drop("_")

    def hubs(self, n: int = 10) -> DataFrame:
        return self.nodes.where("deg > 0").orderBy(F.desc("deg"), "id").limit(n).select("id", "title", "type", "deg")

    def hot(self, n: int = 20) -> DataFrame:
        """The nodes of the highest degree that are neither hubs nor structural."""
        return self.nodes.where(~self.is_hub() & ~self.is_structural()).orderBy(F.desc("deg"), "id").limit(n).select("id", "title", "type", "deg")

    def types(self) -> DataFrame:
        return self.nodes.groupBy("type").count().withColumnRenamed("count", "n")

"""One object for a collection: where it comes from, its graph, and every question that may be put to it."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import note_uri
from .operators import community, relation, similarity
from .operators.anchors import resolve_id, text_search
from .operators.graph import LinkGraph, documents
from .operators.reconcile import Reconciled, diff, merge_renames, rename_touches
from .operators.roaming import Outcome, RandomWalks, RoamOptions, roam
from .plans.durable import cut
from .sources.blocks import is_block_db, read_block_db
from .sources.markdown import read_vault, read_vault_incremental
from .sources.profile import Profile, resolve_profile
from .sources.store import PARSER_VERSION, Store


def clamped(value: object, default: float, low: float, high: float) -> float:
    """A number within its range; what is missing or no number counts as the default."""
    try:
        v = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default
    return default if math.isnan(v) else min(max(v, low), high)


def roam_options(**given: object) -> RoamOptions:
    """Options within their ranges: top 1-60, hops 1-5, decay, least, alpha and beta 0-1."""
    d = RoamOptions()
    whole = lambda k, lo, hi: int(clamped(given.get(k), getattr(d, k), lo, hi))
    part = lambda k: clamped(given.get(k), getattr(d, k), 0.0, 1.0)
    return RoamOptions(whole("top", 1, 60), whole("hops", 1, 5), part("decay"), part("least"), part("alpha"), part("beta"))


def load_source(spark: SparkSession, source: str, profile: Profile | None = None, store: Store | None = None) -> DataFrame:
    """Documents of a store that is not stale, else of a block database (by its ending), else of a folder."""
    profile = profile or resolve_profile(vault=None if is_block_db(source) else source)
    if store is not None and not store.stale(profile):
        return store.load()
    return read_block_db(spark, source) if is_block_db(source) else read_vault(spark, source, profile)


@dataclass
class Refreshed:
    changes: Reconciled
    documents: DataFrame
    renames: DataFrame
    reused: int


def refresh(spark: SparkSession, source: str, store: Store, profile: Profile, touches: DataFrame | None = None, full: bool = False) -> tuple[Refreshed, DataFrame | None]:
    """Bring a store up to date: parse (only what changed, unless full or stale), compare, keep renames, save; touches come back with their names led along. Stored documents keep their references as written."""
    old = cut(store.load())
    reused = 0
    if is_block_db(source):
        new = cut(read_block_db(spark, source))
    elif full or store.stale(profile):
        new = cut(read_vault(spark, source, profile))
    else:
        new, taken = read_vault_incremental(spark, source, profile, old)
        new, reused = cut(new), taken.first()["reused"]
    changes = diff(old, new)
    renames = cut(merge_renames(store.renames(), changes.renames, new))
    store.save_renames(renames)
    store.save(new)
    store.put(parser_version=PARSER_VERSION, profile=profile.signature())
    led = rename_touches(touches, renames) if touches is not None else None
    return Refreshed(changes, new, renames, reused), led


class Collection:
    """Questions to a graph of documents. vault and block_repository name the program that opens a note."""

    def __init__(self, docs: DataFrame, profile: Profile = Profile(), renames: DataFrame | None = None, vault: str = "", block_repository: str = ""):
        self.graph = LinkGraph(documents(docs), profile.structural_types, renames)
        self.walks = RandomWalks(self.graph)
        self.vault, self.block_repository = vault, block_repository

    def with_uri(self, rows: DataFrame) -> DataFrame:
        """Rows (id) with uri."""
        paths = self.graph.docs.select("id", F.col("path").alias("_path"))
        return rows.join(paths, "id", "left").withColumn("uri", note_uri(F.col("_path"), F.col("id"), self.vault, self.block_repository)).drop("_path")

    def roam(self, query: str, **options: object) -> Outcome:
        return roam(self.graph, query, roam_options(**options))

    def random(self, seed: int | None = None, rand_alpha: float = 0.5, **options: object) -> Outcome:
        return self.walks.roam(seed, rand_alpha, roam_options(**options))

    def _named(self, name: str) -> str | None:
        return resolve_id(self.graph.docs, name) if name.strip() else None

    def relation(self, start: str, end: str) -> tuple[DataFrame, DataFrame] | None:
        """The relation of two named nodes and the evidence along its path; None if a name means nothing."""
        a, b = self._named(start), self._named(end)
        if a is None or b is None:
            return None
        found = cut(relation.relation(self.graph, a, b))
        return found, relation.evidence(self.graph, found.first()["path"])

    def similar(self, name: str, k: object = 10) -> DataFrame | None:
        """Similar nodes with the titles of what they share."""
        key = self._named(name)
        if key is None:
            return None
        found = similarity.similar(self.graph, key, int(clamped(k, 10, 1, 60)))
        titles = self.graph.nodes.select(F.col("id").alias("s"), "title")
        shared = found.select("id", F.explode("shared").alias("s")).join(titles, "s").groupBy("id").agg(F.array_sort(F.collect_list("title")).alias("shared_titles"))
        return found.join(shared, "id", "left").orderBy(F.desc("score"), "id")

    def suggest(self, k: object = 50) -> DataFrame:
        return similarity.suggest_links(self.graph, int(clamped(k, 50, 1, 200)))

    def node(self, name: str) -> DataFrame | None:
        key = self._named(name)
        return None if key is None else relation.node_detail(self.graph, key)

    def communities(self, resolution: object = 1.0, seed: int = 1, top: int = 0, node: str | None = None) -> DataFrame:
        found = community.communities(self.graph, clamped(resolution, 1.0, 0.0, 100.0), seed)
        return community.trimmed(found, top, node)

    def stats(self) -> DataFrame:
        return self.graph.stats()

    def dangling(self, most: int = 50) -> DataFrame:
        return self.graph.dangling().orderBy("source", "target").limit(most)

    def hot(self, n: object = 20) -> DataFrame:
        return self.graph.hot(int(clamped(n, 20, 1, 1000)))

    def search(self, query: str, limit: int = 30) -> DataFrame:
        return text_search(self.graph.docs, query, limit)


def to_markdown(outcome: Outcome, query: str, source: str = "", vault: str = "") -> str:
    """An outcome, at most a screen of rows, as a list of cards."""
    out = ["# Roaming\n", f"- Query: `{query}` (source {source}, vault {vault})"]
    anchors = outcome.anchors.orderBy(F.desc("level"), "id").collect()
    results = outcome.results.orderBy("pos").collect()
    hits = outcome.hits.orderBy(F.desc("count"), "id").collect()
    if anchors:
        out += ["\n## Anchors\n", *[f"- **{a['title']}** `{a['id']}` [{a['type']}]{' 🎲' if outcome.random else ''}" for a in anchors]]
    if results:
        out.append("\n## Related\n")
    for r in results:
        out.append(f"- **{r['title']}** `{r['id']}` [{r['type']}]" + (f" · {r['hops']}-hop" if r["hops"] else ""))
        out.append(f"  score {r['score']:.3f} · ppr {r['ppr']:.4f} · act {r['act']:.3f}")
        if r["path"]:
            out.append("  path: `" + " → ".join(r["path"]) + "`")
    if hits:
        out += ["\n## Texts\n", *[f"- **{h['title']}** `{h['id']}` [{h['type']}] · {h['count']} times" for h in hits]]
    if not results and not hits:
        out.append("\n_(nothing found)_")
    return "\n".join(out) + "\n"


def to_json(outcome: Outcome) -> str:
    rows = lambda df, *order: [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]
    return json.dumps({"anchors": rows(outcome.anchors, F.desc("level"), "id"), "results": rows(outcome.results, "pos"), "fallback": outcome.fallback, "hits": rows(outcome.hits, F.desc("count"), "id")}, ensure_ascii=False)

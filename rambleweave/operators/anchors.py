"""Finding the nodes a query names, and texts that mention it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import occurrences

LEVELS = {5: "id", 4: "title", 3: "alias", 2: "tag", 1: "part"}


def resolve(docs: DataFrame, query: str) -> DataFrame:
    """id, level of every document that the trimmed query names: 5 its id, 4 its title, 3 an alias, 2 a tag, 1 part of its id or title. The empty query is part of everything."""
    q = F.lit(query.strip())
    level = (
        F.when(F.col("id") == q, 5)
        .when(F.col("title") == q, 4)
        .when(F.array_contains("aliases", q), 3)
        .when(F.array_contains("tags", q), 2)
        .when(F.contains("id", q) | F.contains("title", q), 1)
    )
    return docs.select("id", level.alias("level")).where("level is not null")


def resolve_id(docs: DataFrame, query: str) -> str | None:
    """The best match: the highest level, the smallest id."""
    row = resolve(docs, query).orderBy(F.desc("level"), "id").first()
    return row["id"] if row else None


def text_search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """id, title, type, count of the texts that hold the query most often; the empty query finds nothing."""
    if not query:
        return docs.select("id", "title", "type", F.lit(0).alias("count")).limit(0)
    hits = docs.select("id", "title", "type", occurrences(F.col("text"), query).alias("count")).where("count > 0")
    return hits.orderBy(F.desc("count"), "id").limit(limit)


def decorate(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Anchors with title, type and degree."""
    return anchors.join(nodes, "id").select("id", "title", "type", "level", "deg")

"""Queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ship import ship
from .neardup import group_pairs, near_duplicates
from .packing import pack, pack_documents
from .sets import clean_tags, link_counts, similar_between, similar_within
from .splitting import split_oversized
from .tokens import decode, encode, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return group_pairs(near_duplicates(_read(spark, sf, "notes")))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each note that has near-duplicates, with its group."""
    return near_duplicates(_read(spark, sf, "notes"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    notes, shared = _read(spark, sf, "notes"), _read(spark, sf, "shared_note")
    refs = similar_within(notes, "id", F.col("refs")).select(F.lit("refs").alias("field"), "id_a", "id_b")
    tags = similar_between(notes, shared, "id", clean_tags(F.col("tags")), clean_tags(F.col("tags"))).where("left_id <> right_id")
    return refs.unionByName(tags.select(F.lit("tags").alias("field"), F.least("left_id", "right_id").alias("id_a"), F.greatest("left_id", "right_id").alias("id_b")).distinct())


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each note with enough refs, with its class of equal sets and its number of links."""
    return link_counts(_read(spark, sf, "notes"), "id", F.col("refs"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(_read(spark, sf, "documents"))


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether decoding gives the text again: number of texts and of those that differ."""
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    back = decode(encode(docs)).select("doc_id", F.md5("text").alias("back"))
    both = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("own")).join(back, "doc_id")
    return both.agg(F.count("*").alias("texts"), F.count_if(F.col("own") != F.col("back")).alias("differing"))


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(_read(spark, sf, "documents"))


def p7_bins(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_read(spark, sf, "documents"))


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_oversized(_read(spark, sf, "documents"))


def _pack_check(bins: DataFrame, sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row of counts: items with a size above 0, how many of them are missing, spread over several containers though they fit one, or not whole; containers that hold too much; and whether the number of containers is the lower bound."""
    fill = bins.groupBy("bin").agg(F.sum("n_tokens").alias("fill"))
    of_item = bins.groupBy("key").agg(F.sum("n_tokens").alias("packed"), F.count("*").alias("pieces"))
    items = sizes.select("key", F.col("n_tokens").alias("size")).where("size > 0").join(of_item, "key", "left")
    whole = items.agg(
        F.count("*").alias("items"), F.count_if(F.col("packed").isNull()).alias("missing"), F.count_if((F.col("size") <= capacity) & (F.col("pieces") > 1)).alias("split"),
        F.count_if(F.col("packed") != F.col("size")).alias("not_whole"), F.ceil(F.sum("size") / capacity).alias("bound"),
    )
    held = fill.agg(F.count_if(F.col("fill") > capacity).alias("overfull"), F.count("*").alias("bins"))
    both = whole.unionByName(held, allowMissingColumns=True)
    total = both.agg(*[F.sum(c).alias(c) for c in both.columns])
    return total.select("items", "missing", "split", "not_whole", "overfull", (F.col("bins") - F.col("bound")).alias("above_bound"))


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """What p7_bins promises, counted over all texts."""
    docs = _read(spark, sf, "documents")
    return _pack_check(pack_documents(docs).withColumnRenamed("doc_id", "key"), token_counts(docs).withColumnRenamed("doc_id", "key"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = split_oversized(_read(spark, sf, "documents"))
    return pieces.select(F.concat_ws(".", F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("key"), "n_tokens")


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of problem 8 in containers of 2,048: four nearly full pieces leave room that best fit can't use, so the islands run."""
    return pack(_pieces(spark, sf), key="key").select("key", "bin", F.col("size").alias("n_tokens"))


def p7_pieces_check(spark: SparkSession, sf: str) -> DataFrame:
    """What p7_pieces promises; the number of containers has no lower bound that must be met here."""
    return _pack_check(p7_pieces(spark, sf), _pieces(spark, sf)).drop("above_bound", "items")


def p8_check(spark: SparkSession, sf: str) -> DataFrame:
    """What p8_pieces promises, counted over all texts: gaps between pieces, texts whose first or last place is missing, pieces beyond the limit or the overlap, pieces whose text is not that of their places; and texts beyond the limit that are not cut."""
    docs = _read(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"))
    pieces = split_oversized(docs.withColumnRenamed("whole", "text"))
    before = Window.partitionBy("doc_id").orderBy("piece")
    linked = pieces.withColumn("prior_end", F.lag("end").over(before)).withColumn("prior_begin", F.lag("begin").over(before))
    each = linked.groupBy("doc_id").agg(
        F.sum(F.when(F.col("prior_end").isNotNull() & ((F.col("begin") > F.col("prior_end")) | (F.col("begin") <= F.col("prior_begin"))), 1).otherwise(0)).alias("gaps"),
        F.min("begin").alias("first"), F.max("end").alias("last"), F.count_if((F.col("n_tokens") > 512) | (F.col("shared") > 64)).alias("too_long"),
        F.xxhash64(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "\0")).alias("texts"),
        F.array_sort(F.collect_list(F.struct("piece", "begin", "end"))).alias("places"),
    )
    cut_text = F.xxhash64(F.array_join(F.transform("places", lambda x: F.substring(F.col("whole"), x["begin"] + 1, x["end"] - x["begin"])), "\0"))
    long = token_counts(docs, text="whole").where("n_tokens > 512").select("doc_id")
    joined = docs.join(long, "doc_id", "left_semi").join(each, "doc_id", "left")
    return joined.agg(
        F.count_if(F.col("places").isNull()).alias("uncut"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"), F.count_if((F.col("first") != 0) | (F.col("last") != F.char_length("whole"))).alias("uncovered"),
        F.coalesce(F.sum("too_long"), F.lit(0)).alias("too_long"), F.count_if(F.col("texts") != cut_text).alias("differing"),
    )


QUERIES: dict[str, Query] = {q.__name__: q for q in (p2_found, p2_groups, p3_found, p3_links, p6_ids, p6_round_trip, p6_counts, p7_bins, p7_check, p7_pieces, p7_pieces_check, p8_pieces, p8_check)}

#: Brute force over all pairs of contents whose sizes allow the similarity.
_NEAR = """RECURSIVE c AS (SELECT DISTINCT id, trim(regexp_replace(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS content FROM notes WHERE id IS NOT NULL),
t AS (SELECT row_number() OVER () AS d, content FROM (SELECT DISTINCT content FROM c WHERE length(content) >= 200)),
g AS (SELECT d, list_sort(list_distinct([content[i : i + 4] FOR i IN range(1, length(content) - 3)])) AS s FROM t),
e AS (SELECT d, unnest(s) AS gram, len(s) AS n FROM g),
q AS (SELECT x.d AS a, y.d AS b FROM e x JOIN e y ON x.gram = y.gram AND x.d < y.d AND x.n >= 0.7 * y.n AND y.n >= 0.7 * x.n GROUP BY x.d, y.d, x.n, y.n HAVING count(*) >= 0.7 * (x.n + y.n - count(*))),
m AS (SELECT c.id, t.d FROM c JOIN t USING (content)),
l AS (SELECT x.id AS a, y.id AS b FROM q JOIN m x ON x.d = q.a JOIN m y ON y.d = q.b UNION SELECT x.id, y.id FROM m x JOIN m y ON x.d = y.d AND x.id <> y.id),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)"""

_SETS = """n AS (SELECT DISTINCT id, refs, tags FROM notes WHERE id IS NOT NULL),
r AS (SELECT DISTINCT id, list_sort(list_distinct([x FOR x IN refs IF x <> ''])) AS s FROM n),
t AS (SELECT DISTINCT id, list_sort(list_distinct([x FOR x IN [lower(regexp_replace(trim(x, ' '), '^#', '')) FOR x IN tags] IF x <> ''])) AS s FROM n),
u AS (SELECT DISTINCT id, list_sort(list_distinct([x FOR x IN [lower(regexp_replace(trim(x, ' '), '^#', '')) FOR x IN tags] IF x <> ''])) AS s FROM shared_note),
re AS (SELECT id, unnest(s) AS v, len(s) AS n FROM r WHERE len(s) >= 4),
te AS (SELECT id, unnest(s) AS v, len(s) AS n FROM t WHERE len(s) >= 3),
ue AS (SELECT id, unnest(s) AS v, len(s) AS n FROM u WHERE len(s) >= 3),
found AS (
SELECT 'refs' AS field, a.id AS id_a, b.id AS id_b FROM re a JOIN re b ON a.v = b.v AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*))
UNION SELECT 'tags', least(a.id, b.id), greatest(a.id, b.id) FROM te a JOIN ue b ON a.v = b.v AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)))"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_SETS} SELECT * FROM found",
    "p3_links": f"""WITH {_SETS}, p AS (SELECT id_a AS a, id_b AS b FROM found WHERE field = 'refs'), l AS (SELECT a, count(*) AS n FROM (SELECT a FROM p UNION ALL SELECT b FROM p) GROUP BY a)
 SELECT r.id, min(r.id) OVER (PARTITION BY r.s) AS class, coalesce(l.n, 0) AS links FROM r LEFT JOIN l ON l.a = r.id WHERE len(r.s) >= 4""",
    "p2_found": f"WITH {_NEAR} SELECT a AS id_a, b AS id_b FROM r WHERE a < b",
    "p2_groups": f'WITH {_NEAR} SELECT a AS id, least(a, min(b)) AS "group" FROM r GROUP BY a',
    "p6_round_trip": "SELECT count(*) AS texts, CAST(0 AS BIGINT) AS differing FROM documents",
    # what the operators promise, as the counts that must come out
    "p7_check": """SELECT count(*) AS items, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS above_bound
 FROM documents WHERE text <> ''""",
    "p7_pieces_check": "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS not_whole, CAST(0 AS BIGINT) AS overfull",
    "p8_check": "SELECT CAST(0 AS BIGINT) AS uncut, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS differing",
}

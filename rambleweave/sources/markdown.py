"""A folder of Markdown files as documents.

The listing reads no contents; names are filtered on it. Contents of what is left are read and parsed by column
expressions; only the YAML front matter, which no built-in function reads, goes through Arrow to Python. Folders of a
local file system are listed and read by tasks of our own: Spark's file source takes a task for every few files, lists
them on each use and passes over names that begin with a dot or an underscore.
"""

from __future__ import annotations

import dataclasses
import json
import os
import random
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import INLINE_LIST, frontmatter_block, heading, links, none, strip_frontmatter
from ..plans.durable import cut, shuffle_partitions
from ..schema import COLUMNS
from .profile import Profile

_META = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("lists", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
_PLAIN_KEY = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
#: A line that YAML and JSON read alike: a key with a quoted string or a list of them, of printable characters, no escapes but these. A key on a line ends within 1,024 characters.
_QUOTED = r'"(?:[ !#-\[\]-~\xa0-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]|\\["\\/bfnrt])*"'
_SIMPLE = re.compile(rf"([A-Za-z_][A-Za-z0-9_]{{0,99}}): ({_QUOTED}|\[(?:{_QUOTED}(?:, {_QUOTED})*)?\])")
#: Keys that YAML takes for something else than strings.
_NO_STRINGS = {"yes", "no", "true", "false", "on", "off", "null"}
#: Entries of the upper folders, which every task lists, for each task; folders that are enough for a task; bytes of contents in a batch.
ENTRIES, FOLDERS, BATCH = 64, 4, 16_000_000


def _simple_yaml(block: str) -> tuple[dict[str, str], dict[str, list[str]]] | None:
    """What parse_yaml gives for front matter of simple lines only, without the parser of YAML, which takes most of a scan's time; else None."""
    meta: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    for line in block.strip("\n").split("\n"):
        m = _SIMPLE.fullmatch(line)
        if not m or m[1].lower() in _NO_STRINGS:
            return None
        value = json.loads(m[2])
        meta[m[1]] = value if isinstance(value, str) else ""
        if items := [x for x in value if x] if isinstance(value, list) else []:
            lists[m[1]] = lists.get(m[1], []) + items
    return meta, lists


def parse_yaml(block: str | None) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Top-level string keys of front matter: scalars as they are written, lists of scalars apart (with an empty value), anything else as an empty value. The last of equal keys holds; broken YAML gives nothing."""
    meta: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    if block is None:
        return meta, lists
    if (simple := _simple_yaml(block)) is not None:
        return simple
    try:
        root = yaml.compose(block, Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return meta, lists
    if not isinstance(root, yaml.MappingNode):
        return meta, lists
    null = "tag:yaml.org,2002:null"
    for k, v in root.value:
        if k.tag != "tag:yaml.org,2002:str" or not _PLAIN_KEY.match(k.value):
            continue
        if isinstance(v, yaml.ScalarNode):
            meta[k.value] = "" if v.tag == null else v.value
            continue
        meta[k.value] = ""
        if isinstance(v, yaml.SequenceNode):
            items = [i.value for i in v.value if isinstance(i, yaml.ScalarNode) and i.tag != null and i.value]
            if items:
                lists[k.value] = lists.get(k.value, []) + items
    return meta, lists


@F.pandas_udf(_META)
def _frontmatter(blocks: pd.Series) -> pd.DataFrame:
    found = [parse_yaml(b) for b in blocks]
    return pd.DataFrame({"meta": [m for m, _ in found], "lists": [x for _, x in found]})


def front_strings(meta: Column, lists: Column, keys: tuple[str, ...]) -> Column:
    """The strings of the first key that has some: a list, an inline [a, b], or one value. An inline list without values ends the search with nothing."""

    def of(k: str) -> Column:
        raw = F.try_element_at(meta, F.lit(k))
        inside = F.transform(F.split(F.regexp_extract(raw, INLINE_LIST, 1), ","), lambda x: F.trim(x))
        return F.coalesce(F.try_element_at(lists, F.lit(k)), F.when(raw.rlike(INLINE_LIST), F.filter(inside, lambda x: x != "")), F.when(raw != "", F.array(raw)))

    return F.coalesce(*[of(k) for k in keys], none())


def title_of(meta: Column, body: Column, key: Column, profile: Profile) -> Column:
    """By the profile's keys, else the smallest key that ends with _name, else the first heading, else the id."""
    given = [F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in profile.title_keys]
    named = F.array_sort(F.filter(F.map_entries(meta), lambda e: e["key"].endswith("_name") & (e["value"] != "")))
    return F.coalesce(*given, F.try_element_at(named, F.lit(1))["value"], heading(body), key)


def _local(spark: SparkSession, root: str) -> str | None:
    """The folder's path if it is one of a local file system, which driver and executors open as files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _entries(folder: str, excluded: tuple[str, ...]) -> tuple[list[str], list[os.DirEntry]]:
    """The folders in a folder, but for excluded ones and links, and its Markdown files. One that is gone has none."""
    folders, files = [], []
    try:
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in excluded:
                        folders.append(e.path)
                elif e.name[-3:].lower() == ".md" and e.is_file():
                    files.append(e)
    except FileNotFoundError:
        pass
    return folders, files


def _walker(root: str, excluded: tuple[str, ...], depth: int, parts: int, salt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists the share of each task: folders of a depth, with all below, and files above, by hashes of their paths. salt: another one for each scan, as Spark would take a scan for an earlier one of equal plan that is cached."""

    def mine(path: str, part: int) -> bool:
        return zlib.crc32(os.fsencode(path), salt) % parts == part

    def files_of(part: int) -> Iterator[os.DirEntry]:
        level = [root]
        for _ in range(depth):
            below = []
            for folder in level:
                folders, files = _entries(folder, excluded)
                yield from (f for f in files if mine(f.path, part))
                below += folders
            level = below
        left = [f for f in level if mine(f, part)]
        while left:
            folders, files = _entries(left.pop(), excluded)
            yield from files
            left += folders

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        path, t, size = zip(*rows)
        return pa.RecordBatch.from_pydict({"uri": pa.array(path, pa.string()), "t": pa.array(t, pa.int64()), "size": pa.array(size, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for given in batches:
            for part in given.column(0).to_pylist():
                for f in files_of(part):
                    try:
                        at = f.stat()
                    except FileNotFoundError:
                        continue
                    rows.append((f.path, at.st_mtime_ns // 1000, at.st_size))
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def _local_files(spark: SparkSession, home: str, excluded: tuple[str, ...]) -> DataFrame:
    """path, modificationTime, length of the Markdown files below a folder, each listed by one task. The driver lists upper folders only, to see from which depth on they are many."""
    if not os.path.isdir(home):
        raise FileNotFoundError(home)
    # every task lists the upper folders, so not more tasks than keep all cores busy
    most, level, depth, seen = min(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism), [home], 0, 0
    while level and len(level) < FOLDERS * most:
        below = []
        for folder in level:
            folders, files = _entries(folder, excluded)
            below += folders
            seen += len(folders) + len(files)
        level, depth = below, depth + 1
    parts = min(most, 1 + seen // ENTRIES)
    # made of an RDD, whose size is not known beforehand: that of a few numbers would have Spark broadcast what they name
    shares = spark.createDataFrame(spark.sparkContext.parallelize([(k,) for k in range(parts)], parts), "part long")
    rows = shares.mapInArrow(_walker(home, excluded, depth, parts, random.getrandbits(32)), "uri string, t long, size long")
    return rows.select(F.col("uri").alias("path"), F.timestamp_micros("t").alias("modificationTime"), F.col("size").alias("length"))


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime, length of the Markdown files without a byte, which Spark's listing passes over. They are found by a walk on the driver, as listings are."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    if fs.exists(at):
        each = fs.listFiles(at, True)
        while each.hasNext():
            s = each.next()
            if s.getLen() == 0 and s.getPath().getName().lower().endswith(".md"):
                found.append((s.getPath().toString(), s.getModificationTime() * 1000))
    return spark.createDataFrame(found, "path string, t long").select("path", F.timestamp_micros("t").alias("modificationTime"), F.lit(0).cast("long").alias("length"))


def vault_files(spark: SparkSession, root: str, profile: Profile) -> DataFrame:
    """path (relative), uri, mtime, size of the Markdown files that the profile doesn't leave out; contents are not read."""
    if home := _local(spark, root):
        base = home.rstrip("/")
        files = _local_files(spark, base or "/", tuple(profile.excluded_dirs))
    else:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        base = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
        files = files.select("path", "modificationTime", "length").unionByName(_empty_files(spark, root))
    rel = F.substring("path", len(base) + 2, 100_000)
    listed = files.select(F.col("path").alias("uri"), rel.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    hidden = F.arrays_overlap(dirs, F.array(*map(F.lit, profile.excluded_dirs))) if profile.excluded_dirs else F.lit(False)
    return listed.where(~hidden & ~profile.excluded_name(F.element_at(F.split("path", "/"), -1)))


def with_ids(files: DataFrame) -> DataFrame:
    """Files (path) with id: the file's name without .md; from the second file of a name on (in walking order), its path without .md."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    order = Window.partitionBy("stem").orderBy(F.split("path", "/"))
    numbered = files.withColumn("stem", stem).withColumn("_n", F.row_number().over(order))
    return numbered.withColumn("id", F.when(F.col("_n") == 1, F.col("stem")).otherwise(F.regexp_replace("path", r"\.md$", ""))).drop("stem", "_n")


def parse(files: DataFrame, profile: Profile) -> DataFrame:
    """Documents of files (id, path, mtime, size, whole text as raw). Links come from the whole text, front matter included; text is the body, after descriptions and resources of the front matter."""
    read = files.withColumn("f", _frontmatter(frontmatter_block(F.col("raw")))).withColumn("body", strip_frontmatter(F.col("raw")))
    meta, lists = F.col("f.meta"), F.col("f.lists")
    said = lambda keys: F.filter(front_strings(meta, lists, keys), lambda x: F.trim(x) != "")
    extra = F.array_join(F.concat(said(profile.description_keys), F.transform(said(profile.resource_keys), lambda x: F.concat(F.lit("资源: "), x))), "\n")
    return read.select(
        "id",
        title_of(meta, F.col("body"), F.col("id"), profile).alias("title"),
        front_strings(meta, lists, profile.alias_keys).alias("aliases"),
        profile.type_of(F.col("path"), meta).alias("type"),
        "path",
        "mtime",
        "size",
        links(F.col("raw")).alias("refs"),
        front_strings(meta, lists, profile.tag_keys).alias("tags"),
        F.when(extra != "", F.concat(extra, F.lit("\n\n"), "body")).otherwise(F.col("body")).alias("text"),
    ).select(*COLUMNS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds content, the bytes of the file uri (none if it is gone), in batches of about BATCH bytes."""
    for given in batches:
        begin, held, contents = 0, 0, []
        for k, uri in enumerate(given.column("uri").to_pylist()):
            try:
                with open(uri, "rb") as f:
                    contents.append(f.read())
            except FileNotFoundError:
                contents.append(b"")
            held += len(contents[-1])
            if held >= BATCH or k + 1 == given.num_rows:
                yield pa.RecordBatch.from_arrays([*given.slice(begin, k + 1 - begin).columns, pa.array(contents, pa.binary())], names=[*given.schema.names, "content"])
                begin, held, contents = k + 1, 0, []


def _contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    if _local(spark, root):
        spread = files.repartition(shuffle_partitions(spark), "uri")  # rows are small, what they name is not
        return spread.mapInArrow(_read, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])).withColumn("raw", F.decode("content", "UTF-8")).drop("content")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(root)
    return files.join(raw.select(F.col("path").alias("uri"), F.decode("content", "UTF-8").alias("raw")), "uri", "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def read_vault(spark: SparkSession, root: str, profile: Profile = Profile()) -> DataFrame:
    """All documents of a folder. An empty folder gives none; files that aren't Markdown, and what the profile leaves out, are not read."""
    return parse(_contents(spark, root, with_ids(vault_files(spark, root, profile))), profile)


def read_vault_incremental(spark: SparkSession, root: str, profile: Profile, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same documents, and one row with the number of those taken over from old: same path, size and time to the second. Ids are given anew, so a later file of a name gets its path as ever."""
    files = cut(with_ids(vault_files(spark, root, profile)))  # one listing, whatever is asked of it
    second = lambda c: F.date_trunc("second", c)
    known = old.select(F.col("path").alias("p"), second("mtime").alias("t"), F.col("size").alias("s"), F.struct(*[c for c in COLUMNS if c != "id"]).alias("row"))
    met = files.join(known, (F.col("path") == F.col("p")) & (second(F.col("mtime")) == F.col("t")) & (F.col("size") == F.col("s")), "left")
    same = met.where("row is not null")
    # A title that was the id stands for the file's name: it follows the id.
    kept = same.select("id", *[F.col("row")[c].alias(c) for c in COLUMNS if c != "id"]).select(*COLUMNS)
    fresh = met.where("row is null").select("id", "uri", "path", "mtime", "size")
    return kept.unionByName(parse(_contents(spark, root, fresh), profile)), same.agg(F.count("*").alias("reused"))


_DETECT_WORDS = ("章节", "大纲", "报告", "仪表盘", "dashboard", "chapter", "outline", "report", "log", "state", "index", "ingest")  # fixed values


def detect_profile(spark: SparkSession, root: str) -> Profile:
    """A profile for a folder, from counts over its files: folders, prefixes and front matter keys that recur. Only the counts that reach their least number come to the driver."""
    plain = vault_files(spark, root, dataclasses.replace(Profile(), excluded_dirs=()))
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    tools = {r[0] for r in plain.select(F.explode(folders).alias("d")).where(F.col("d").startswith(".")).distinct().collect()}
    excluded = tuple(sorted({*Profile().excluded_dirs, *tools}))
    files = vault_files(spark, root, dataclasses.replace(Profile(), excluded_dirs=excluded))
    base = F.regexp_replace(F.element_at(parts, -1), r"\.md$", "")
    first = F.when(F.size(parts) > 1, parts[0])
    dotted = F.when(base.startswith("."), F.nullif(F.regexp_extract(base, r"^(\.[^-_]*)[-_]", 1), F.lit("")))
    prefix = F.when(~base.startswith("."), F.nullif(F.regexp_extract(base, r"^([^_]+)_", 1), F.lit("")))
    rows = files.select(F.explode(F.array(*[F.struct(F.lit(k).alias("what"), v.alias("name")) for k, v in (("dir", first), ("prefix", prefix), ("dot", dotted), ("canvas", F.when(F.contains(base, F.lit(".excalidraw")), "画布")))])).alias("x")).select("x.*")
    counts = rows.where("name is not null").groupBy("what", "name").count()
    least = F.when(F.col("what") == "dir", 2).when(F.col("what") == "prefix", 3).otherwise(1)
    got = sorted((r["what"], r["name"]) for r in counts.where(F.col("count") >= least).collect())
    of = lambda what: [n for w, n in got if w == what]
    keys = _contents(spark, root, with_ids(files)).select(F.explode(F.map_keys(_frontmatter(frontmatter_block(F.col("raw")))["meta"])).alias("k"))
    keys = {r["k"]: r["count"] for r in keys.groupBy("k").count().where("count >= 3 or k in ('title', 'name', 'aliases', 'tags', 'chapter_id')").collect()}
    titles = [k for k in ("title", "name") if keys.get(k)] or ["title"]
    titles += sorted(k for k, n in keys.items() if n >= 3 and k.endswith(("_name", "_title")) and k not in ("name", "title"))
    by_dir = tuple((n, n) for n in of("dir") if n not in excluded)
    by_prefix = (*((n + "_", n) for n in of("prefix")), *((n, "报告") for n in of("dot")))
    structural = {t for _, t in (*by_dir, *by_prefix) if any(w in t.lower() for w in _DETECT_WORDS)} | ({"画布"} if of("canvas") else set()) | ({"章节"} if keys.get("chapter_id") else set())
    return dataclasses.replace(
        Profile(), name=os.path.basename(root.rstrip("/\\")), excluded_dirs=excluded, title_keys=tuple(titles), type_by_dir=by_dir, type_by_prefix=by_prefix,
        type_by_ext=((".excalidraw", "画布"),) if of("canvas") else (), structural_types=tuple(sorted({"container", *structural})),
    )



"""Column expressions for texts, names and links. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns by which links, code and placeholders are found in Markdown.
WIKI_LINK = r"\[\[([^\]]+)\]\]"
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)\s]+)\)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
HEADING = r"(?md)^#\s+(.+?)\s*$"
INLINE_LIST = r"(?sd)^\s*\[(.*)\]\s*$"
FENCE = r"(?s)```.*?```|~~~.*?~~~"
INLINE_CODE = r"`[^`]*`"
PLACEHOLDER = r"^[^\s]+_[xX]{2,}$"
PLACEHOLDER_WORDS = ["...", "…", "wikilink"]

SUMMARY = 200


def none() -> Column:
    """An empty list of strings."""
    return F.array().cast("array<string>")


def clean_list(c: Column) -> Column:
    """A list without null and empty elements; null counts as empty."""
    return F.filter(F.coalesce(c, none()), lambda x: x.isNotNull() & (x != ""))


def utc(seconds: Column) -> Column:
    """The time in UTC that epoch seconds stand for, whatever the session's time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def is_numeric(c: Column) -> Column:
    """Whether a name is all ASCII digits, and not empty."""
    return c.rlike(r"\A[0-9]+\z")


def title_or_id(title: Column, key: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), key)


def summary(text: Column, most: int = SUMMARY) -> Column:
    """The first characters of a text, with … if there are more."""
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def occurrences(text: Column, query: str) -> Column:
    """How often a query occurs in a text, without overlaps and regardless of case."""
    q = F.lower(F.lit(query))
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.char_length(low) - F.char_length(F.replace(low, q, F.lit("")))) / F.char_length(q)).cast("int")


def trimmed(c: Column) -> Column:
    """A text without white space at its ends, of any alphabet (also U+00A0 and U+3000)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def strip_code(text: Column) -> Column:
    """Fenced and inline code replaced by one blank each."""
    return F.regexp_replace(F.regexp_replace(text, FENCE, " "), INLINE_CODE, " ")


def is_placeholder(name: Column) -> Column:
    return F.lower(trimmed(name)).isin(PLACEHOLDER_WORDS) | name.rlike(PLACEHOLDER)




def links(text: Column) -> Column:
    """The distinct names a Markdown text refers to: wiki links first, then relative links to .md files; null gives none."""
    plain = strip_code(F.coalesce(text, F.lit("")))
    before = lambda x, signs: F.regexp_replace(x, rf"(?s)[{signs}].*$", "")
    wiki = F.transform(
        F.regexp_extract_all(plain, F.lit(WIKI_LINK), 1),
        lambda x: F.regexp_replace(F.regexp_replace(trimmed(before(x, "|#")), r"\\+$", ""), r"\.md$", ""),
    )
    target = F.transform(F.regexp_extract_all(plain, F.lit(MARKDOWN_LINK), 1), lambda x: F.regexp_replace(before(trimmed(x), "#?"), "/+$", ""))
    notes = F.filter(target, lambda x: ~x.rlike(SCHEME) & F.lower(x).endswith(".md"))
    names = F.transform(notes, lambda x: F.element_at(F.split(F.regexp_replace(x, r"\.md$", ""), "/"), -1))
    return F.filter(F.array_distinct(F.concat(wiki, names)), lambda x: (x != "") & ~is_placeholder(x))


def strip_frontmatter(text: Column) -> Column:
    """What follows the closing line of the front matter; the whole text if there is none."""
    end = F.locate("\n---", text, 4)
    return F.when(F.startswith(text, F.lit("---")) & (end > 0), F.substring(text, end + 4, F.char_length(text))).otherwise(text)


def frontmatter_block(text: Column) -> Column:
    """The YAML between the opening and the closing line; null if there is none."""
    end = F.locate("\n---", text, 4)
    return F.when(F.startswith(text, F.lit("---")) & (end > 0), F.substring(text, F.lit(4), end - 4))


def heading(body: Column) -> Column:
    """The first heading of level one; null if there is none."""
    return F.nullif(trimmed(F.regexp_extract(body, HEADING, 1)), F.lit(""))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_similarity(a: Column, b: Column) -> Column:
    """0 for different directories, else 0.9 and up to 0.1 by the common start (in bytes) of the file names."""
    x, y = F.hex(F.encode(basename(a), "UTF-8")), F.hex(F.encode(basename(b), "UTF-8"))
    longest = F.greatest(F.length(x), F.length(y)) / 2
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(x), F.length(y)) / 2).cast("int"))
    same = F.size(F.filter(steps, lambda n: (F.least(F.length(x), F.length(y)) > 0) & (F.substring(x, F.lit(1), n * 2) == F.substring(y, F.lit(1), n * 2))))
    return F.when(directory(a) != directory(b), 0.0).otherwise(F.lit(0.9) + 0.1 * same / F.greatest(longest, F.lit(1.0)))


def note_uri(path: Column, key: Column, vault: str = "", block_repository: str = "") -> Column:
    """A link that opens a note in its program; empty where the names needed for it are."""
    if block_repository:
        return F.when(F.coalesce(key, F.lit("")) == "", "").otherwise(F.concat(F.lit("orca-note://"), F.url_encode(F.lit(block_repository)), F.lit("/block?blockId="), F.url_encode(key)))
    if not vault:
        return F.lit("")
    file = F.url_encode(F.regexp_replace(path, r"\.md$", ""))
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(F.concat(F.lit("obsidian://open?vault="), F.url_encode(F.lit(vault)), F.lit("&file="), file))

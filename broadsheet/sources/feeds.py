"""Source lists, feed parsing and source expansion (A1-A5, C4).

Feeds arrive as a raw-feed table ``(feed_url, xml)`` (the fetch step's output)
and are cut into entries, each of which Spark's ``from_xml`` parses for itself (RSS
``item`` or Atom ``entry``); each feed document is one row, entries are
exploded with their position, so no feed is expanded on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.functions.html import reference_names
from broadsheet.functions.text import ws_strip
from broadsheet.functions.urls import is_feed_url
from broadsheet.schemas import ITEM

_BROKEN = "_broken"

# one entry of RSS 2.0, RSS 1.0 or Atom
ENTRY = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("title", "pubDate", "published", "issued", "updated", "modified", "dc:date")],
    T.StructField("link", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("_VALUE", "_href", "_rel")]))),
    T.StructField("guid", T.StructType([T.StructField(n, T.StringType()) for n in ("_VALUE", "_isPermaLink")])),
    T.StructField(_BROKEN, T.StringType())])  # the last: from_xml fills the fields before it by position

XML_OPTS = {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE", "columnNameOfCorruptRecord": _BROKEN}

_PREFIX = r"(?:[A-Za-z_][\w.\-]*:)?"
ROOT_RE = rf"(?i)^[^<]*<{_PREFIX}(?:rss|feed|RDF|channel)(?=[\s/>])"
ENTRY_START_RE = rf"(?=<{_PREFIX}(?:item|entry)[\s>])"
WHOLE_ENTRY_RE = rf"(?s)^(<({_PREFIX}(?:item|entry))[\s>].*?</\2\s*>)"
XML_NAMES = ("amp", "lt", "gt", "quot", "apos")


def source_lines(lines: DataFrame, line_col: str = "value", pos_col: str = "pos") -> DataFrame:
    """A1: trimmed non-blank lines whose raw first character is not ``#``.

    Output ``(source_ord, source_url)``; ``source_ord`` is the line position:
    any orderable value, also a struct such as ``(file, line)``.
    """
    raw = F.col(line_col)
    return (lines.filter((ws_strip(raw) != "") & ~F.coalesce(raw.startswith("#"), F.lit(False)))
            .select(F.col(pos_col).alias("source_ord"), ws_strip(raw).alias("source_url")))


def read_source_list(spark, path: str) -> DataFrame:
    """A1 scan of a sources text file; positions are assigned at the scan (no shuffle before)."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    return source_lines(lines)


def _escaped(x: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(char), F.lit(ref))
    return x


def _without_cdata(x: Column) -> Column:
    """CDATA sections as escaped text."""
    def section(part: Column) -> Column:
        text = F.substring_index(part, "]]>", 1)
        return F.concat(_escaped(text), F.substring(part, F.length(text) + 4, F.length(part)))

    parts = F.split(x, r"<!\[CDATA\[", -1)
    joined = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), section), ""))
    return F.when(x.contains("<![CDATA["), joined).otherwise(x)


def _without_html_names(x: Column) -> Column:
    """The named references of HTML 4 as characters, all but the five of XML."""
    chars = reference_names(XML_NAMES)
    names = F.array_distinct(F.regexp_extract_all(x, F.lit("&([A-Za-z][A-Za-z0-9]*);"), 1))
    known = F.filter(names, lambda n: F.try_element_at(chars, n).isNotNull())
    decoded = F.reduce(known, x, lambda t, n: F.replace(t, F.concat(F.lit("&"), n, F.lit(";")), F.element_at(chars, n)))
    return F.when(x.rlike("&[A-Za-z]"), decoded).otherwise(x)


def plain_xml(df: DataFrame, col: str) -> DataFrame:
    """``col`` without what a parser may stumble over outside of entries or in any text.

    Byte order mark, declarations, processing instructions, document types,
    comments and control characters go, CDATA sections become text, named HTML
    references characters, and every other ampersand that begins no reference
    is escaped.  One named column a step, so each pass runs once per document.
    """
    df = df.withColumn(col, _without_cdata(F.col(col)))
    df = df.withColumn(col, F.regexp_replace(F.col(col), r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[[^\]]*\]\s*)?>|[\x00-\x08\x0B\x0C\x0E-\x1F\uFEFF\uFFFE\uFFFF]", ""))
    df = df.withColumn(col, _without_html_names(F.col(col)))
    return df.withColumn(col, F.regexp_replace(F.col(col), rf"&(?!#[0-9]{{1,7}};|#x[0-9A-Fa-f]{{1,6}};|(?:{'|'.join(XML_NAMES)});)", "&amp;"))


def _whole_entry(chunk: Column) -> Column:
    """The entry a chunk begins with, without its own prefix; empty if it is not closed."""
    entry = F.regexp_extract(chunk, WHOLE_ENTRY_RE, 1)
    prefix = F.regexp_extract(chunk, r"^<([A-Za-z_][\w.\-]*:)", 1)
    bare = F.replace(F.replace(entry, F.concat(F.lit("<"), prefix), F.lit("<")), F.concat(F.lit("</"), prefix), F.lit("</"))
    return F.when(prefix == "", entry).otherwise(bare)


def _link(e: Column) -> Column:
    """The page an entry stands for: the text of its link, else its alternate (the default kind) or first reference, else a permanent guid."""
    links = F.coalesce(e["link"], F.array().cast(ENTRY["link"].dataType))
    texts = F.filter(links, lambda k: k["_VALUE"] != "")
    page = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    permanent = F.when(F.lower(F.coalesce(e["guid"]["_isPermaLink"], F.lit("true"))) == "true", e["guid"]["_VALUE"])
    return F.coalesce(F.try_element_at(texts, F.lit(-1))["_VALUE"], F.get(page, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"], permanent)


def parse_feeds(feeds: DataFrame, url_col: str = "feed_url", xml_col: str = "xml") -> DataFrame:
    """A3 (parse): one row per feed URL with ``ok`` (RSS 1.0 or 2.0 or Atom) and its
    entries as ``array<struct<title, link, published>>`` in document order.

    Documents are cut into single entries before anything is parsed, so a
    broken or unclosed entry is lost alone.  ``ok`` is false where no entry
    could be read and the document is malformed (or no feed at all).  A feed
    URL stored several times counts once: a readable document before others,
    then by hash.  Each stored document is parsed where it is scanned; only
    the short entries are grouped.
    """
    rows = plain_xml(feeds.select(F.col(url_col).alias("feed_url"), F.col(xml_col).alias("x"), F.xxhash64(xml_col).alias("h")), "x")
    rows = rows.withColumn("is_feed", F.coalesce(F.col("x").rlike(ROOT_RE), F.lit(False)))
    rows = rows.withColumn("chunks", F.when(F.col("is_feed"), F.split("x", ENTRY_START_RE, -1)))
    rows = rows.withColumn("read", F.transform(F.slice("chunks", 2, F.greatest(F.size("chunks"), F.lit(1))),
                                               lambda c: F.from_xml(_whole_entry(c), ENTRY, XML_OPTS)))
    entries = F.transform(F.filter("read", lambda e: e.isNotNull() & e[_BROKEN].isNull()), lambda e: F.struct(
        e["title"].alias("title"), _link(e).alias("link"),
        F.coalesce(e["pubDate"], e["published"], e["issued"], e["updated"], e["modified"], e["dc:date"]).alias("published")))
    rows = rows.select("feed_url", "h", "x", "is_feed", F.size("chunks").alias("n_chunks"), entries.alias("entries"))
    empty_root = T.StructType([T.StructField(_BROKEN, T.StringType())])
    whole = F.when(F.col("is_feed") & (F.col("n_chunks") == 1), F.from_xml("x", empty_root, XML_OPTS)[_BROKEN].isNull())  # a feed without entries
    rows = rows.select("feed_url", "h", "entries", (F.coalesce(F.size("entries") > 0, F.lit(False)) | F.coalesce(whole, F.lit(False))).alias("ok"))
    best = rows.groupBy("feed_url").agg(F.min_by(F.struct("ok", "entries"), F.struct(~F.col("ok"), "h")).alias("best"))
    return best.select("feed_url", F.col("best.ok").alias("ok"), F.when(F.col("best.ok"), F.col("best.entries")).alias("entries"))


def kept_entries(parsed: DataFrame, limit: int | None = None) -> DataFrame:
    """C4: ``parsed`` with ``kept``, the first ``limit`` entries that have a link, as struct<pos, title, link, published>."""
    kept = F.filter(F.transform("entries", lambda e, i: F.struct(i.alias("pos"), F.coalesce(e["title"], F.lit("Untitled")).alias("title"),
                                                                 e["link"].alias("link"), e["published"].alias("published"))), lambda e: e["link"] != "")
    return parsed.withColumn("kept", kept if limit is None else F.slice(kept, 1, limit))


def feed_items(parsed: DataFrame, limit: int | None = None) -> DataFrame:
    """A3 + C4: kept entries (those with a link) in order, title default
    ``Untitled``, ``published`` else ``updated``, first ``limit`` kept ones."""
    e = kept_entries(parsed.filter("ok"), limit).select("feed_url", F.explode("kept").alias("e"))
    return e.select("feed_url", "e.pos", "e.title", "e.link", "e.published")


def expand_sources(sources: DataFrame, feeds: DataFrame, limit: int | None = None) -> DataFrame:
    """A4: replace each source by the article URLs it stands for.

    Feed-looking URL: its entries (possibly none), or itself when the feed
    cannot be parsed.  Other URL: its entries if it parses as a feed with
    entries, else itself.  Output ``(ord, source_ord, pos, source_url, url,
    n_entries)``: ``ord`` is the struct ``(source_ord, pos)`` and ``n_entries``
    the number of URLs the source line stands for (B11).
    """
    found = kept_entries(parse_feeds(feeds), limit).select(
        F.col("feed_url").alias("source_url"), F.col("ok").alias("parsed_ok"),
        F.transform("kept", lambda e: F.struct(e["pos"].alias("pos"), e["link"].alias("url"))).alias("links"))
    itself = F.array(F.struct(F.lit(0).alias("pos"), F.col("source_url").alias("url")))
    use = F.when(is_feed_url(F.col("source_url")), F.coalesce("parsed_ok", F.lit(False))).otherwise(F.coalesce(F.size("links"), F.lit(0)) > 0)
    out = (sources.join(found, "source_url", "left").withColumn("links", F.when(use, F.col("links")).otherwise(itself))
           .select("source_ord", "source_url", F.size("links").cast("long").alias("n_entries"), F.explode("links").alias("e"))
           .select("source_ord", "e.pos", "source_url", "e.url", "n_entries"))
    return out.withColumn("ord", F.struct("source_ord", "pos"))


def read_items_json(spark, path: str) -> DataFrame:
    """A5: items array file (JSON array root, explicit schema, FAILFAST).

    A non-array root or a missing ``title``/``url`` fails the read.
    """
    roots = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 4096).alias("head"))
    if roots.filter(~F.col("head").rlike(r"^\s*\[")).limit(1).count():
        raise ValueError("items file has no array at its root")
    df = (spark.read.schema(ITEM).option("multiLine", True).option("mode", "FAILFAST").json(path))
    bad = df.filter(F.col("title").isNull() | F.col("url").isNull()).limit(1).count()
    if bad:
        raise ValueError("items file has an entry without title or url")
    return df


def parse_items_json(docs: DataFrame, json_col: str = "doc") -> DataFrame:
    """A5 on a column of JSON array documents: one row per item with its position.

    ``valid`` is false for documents whose root is not an array or that hold
    an item without title/url (such a run would fail as a whole).
    """
    arr = F.from_json(F.col(json_col), T.ArrayType(ITEM), {"mode": "PERMISSIVE"})
    root_is_array = F.col(json_col).rlike(r"(?s)^\s*\[")
    p = docs.withColumn("_items", F.when(root_is_array, arr))
    p = p.withColumn("valid", F.col("_items").isNotNull()
                     & F.forall(F.coalesce("_items", F.array()), lambda i: i["title"].isNotNull() & i["url"].isNotNull()))
    return p.select(*[c for c in docs.columns if c != json_col], "valid",
                    F.posexplode_outer("_items").alias("pos", "item"))

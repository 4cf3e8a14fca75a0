"""HTML column functions: page metadata and main text by regex (B1, B2 fast path).

The regex path is exact for pages whose structure is unambiguous (see
``regex_safe``); other pages go to the parser path in
``broadsheet.operators.pages``.  Steps: drop comments, drop the removed
elements, take the container span, tags to spaces, decode entities
(``&amp;`` last), collapse whitespace.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import normalize_whitespace, ws_strip

# Elements removed before text extraction, and the containers
# tried in order (then body, then the whole document).
REMOVED_TAGS = ["script", "style", "nav", "header", "footer", "aside"]
CONTAINERS = ["article", "main"]

# The entities the regex path decodes; pages with any other
# entity or character reference take the parser path.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
KNOWN_ENTITY_RE = "&(?:lt|gt|quot|#39|apos|nbsp|copy|middot|amp);"

TAG_RE = r"<(?:/?[A-Za-z][^>]*|![^>]*|\?[^>]*)>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def decode_entities(x) -> Column:
    """Decode the known entities (``&amp;`` last, so ``&amp;lt;`` stays ``&lt;``)."""
    c = _c(x)
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def reference_names(without: tuple[str, ...] = ()) -> Column:
    """Map from the reference names of HTML 4 and ``apos`` to their characters, written as one literal."""
    pairs = [f"{k}\x02{chr(c)}" for k, c in {**name2codepoint, "apos": 39}.items() if k not in without]
    return F.str_to_map(F.lit("\x01".join(pairs)), F.lit("\x01"), F.lit("\x02"))


def decode_references(x) -> Column:
    """Decode the named references of HTML 4, ``&apos;`` and all numeric ones (``&amp;`` last)."""
    names = reference_names()

    def char(ref: Column) -> Column:
        body = F.substring(ref, 2, 32).substr(F.lit(1), F.length(ref) - 2)
        hexa = F.when(body.rlike("^#[xX]"), F.substring(body, 3, 8)).otherwise(F.hex(F.substring(body, 2, 7).cast("long")))
        code = F.conv(hexa, 16, 10).cast("long")
        valid = body.rlike("^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6})$") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")).when(~body.startswith("#"), F.try_element_at(names, body)), ref)

    def decoded(c: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(c, F.lit("&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"), 0))
        last = F.filter(refs, lambda r: r == "&amp;")
        return F.reduce(F.concat(F.array_remove(refs, "&amp;"), last), c, lambda t, r: F.replace(t, r, char(r)))

    c = _c(x)
    return F.when(c.contains("&"), decoded(c)).otherwise(c)


# what may follow a tag's name
END = r"(?=[\s/>])"


def strip_removed(html) -> Column:
    """Comments and removed elements become a space."""
    c = F.regexp_replace(_c(html), r"(?s)<!--.*?-->", " ")
    for t in REMOVED_TAGS:
        c = F.regexp_replace(c, rf"(?is)<{t}{END}[^>]*>.*?</{t}\s*>", " ")
    return c


def metadata_source(html) -> Column:
    """The page without comments, scripts and styles, whose text may look like tags."""
    c = F.regexp_replace(_c(html), r"(?s)<!--.*?(?:-->|\z)", " ")
    for t in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{t}{END}[^>]*>.*?</{t}\s*>", " ")
    return c


def structure_tokens(html) -> Column:
    """Starts of the removed elements' and containers' tags, lower-cased, in page order."""
    names = "|".join(REMOVED_TAGS + CONTAINERS)
    return F.transform(F.regexp_extract_all(_c(html), F.lit(rf"(?i)</?(?:{names}){END}"), 0), lambda t: F.lower(t))


def regex_safe(html, stripped=None, tokens=None) -> Column:
    """True when the regex path gives the parser's answer for this page.

    Each container / removed tag opens at most once and is closed, no
    unknown entity or numeric reference occurs, comments do not hide inside
    raw-text elements, no quoted attribute holds a ``>``, and no
    ``.content``/``#content`` container competes with body when the stripped
    page (``stripped``, else computed) has no article/main.  The structural
    tags are counted on the page's short token list (``tokens``: a named column
    of :func:`structure_tokens`; without it every count repeats the pass).
    """
    h = _c(html)
    left = strip_removed(h) if stripped is None else _c(stripped)
    toks = structure_tokens(h) if tokens is None else _c(tokens)
    ok = F.lit(True)
    for t in REMOVED_TAGS + CONTAINERS:
        opens = F.size(F.filter(toks, lambda x: x == F.lit("<" + t)))
        closes = F.size(F.filter(toks, lambda x: x == F.lit("</" + t)))
        ok = ok & (opens <= 1) & (opens == closes)
    ok = ok & ~h.rlike("&(?!" + KNOWN_ENTITY_RE[1:] + ")")
    ok = ok & ~h.rlike(r"(?is)<(script|style)\b[^>]*>(?:(?!</\1).)*?<!--")
    ok = ok & ~h.rlike(r"""<[A-Za-z/][^<>]*=\s*(?:"[^">]*>|'[^'>]*>)""")
    has_container = left.rlike(rf"(?i)<(article|main){END}")
    content_attr = left.rlike(r"(?i)<[a-z][^>]*\b(class\s*=\s*[\"']?[^\"'>]*\bcontent\b|id\s*=\s*[\"']?content[\"'\s>])")
    return ok & (has_container | ~content_attr)


def container_text(stripped) -> Column:
    """B2 regex path on a stripped page: first article, else main, else body, else everything."""
    s = _c(stripped)
    span = F.lit(None).cast("string")
    for t, close in (("body", r"(?:</body\s*>|\z)"), ("main", r"</main\s*>"), ("article", r"</article\s*>")):
        inner = F.regexp_extract(s, rf"(?is)<{t}{END}[^>]*>(.*?){close}", 1)
        span = F.when(s.rlike(rf"(?i)<{t}{END}"), inner).otherwise(span)
    return normalize_whitespace(decode_entities(F.regexp_replace(F.coalesce(span, s), TAG_RE, " ")))


# The meta tags read, and the columns they end in.
META_TAGS = {"og_title": ("property", "og:title"), "article_author": ("property", "article:author"), "author": ("name", "author"),
             "published": ("property", "article:published_time"), "date": ("name", "date")}


def _meta_tag(html: Column, attr: str, value: str) -> Column:
    """The first ``<meta>`` whose ``attr`` is exactly ``value``, empty if there is none.

    Attribute order and quoting style are free, the value match is case-sensitive.
    """
    v = rf"(?-i:{value})"
    return F.regexp_extract(html, rf"(?is)<meta{END}[^>]*\b{attr}\s*=\s*(?:\"{v}\"|'{v}'|{v}(?=[\s/>]))[^>]*>", 0)


def _content(tag: Column) -> Column:
    """The content attribute of a tag, NULL if it has none."""
    dq = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*\"([^\"]*)\"", 1)
    sq = F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*'([^']*)'", 1)
    return F.when(tag.rlike(r"(?is)\bcontent\s*=\s*\""), dq).when(tag.rlike(r"(?is)\bcontent\s*=\s*'"), sq)


def _truthy_strip(raw: Column) -> Column:
    """Python ``x.strip() if x else None``: non-empty raw value, stripped (may become '')."""
    return F.when(F.coalesce(raw, F.lit("")) != "", ws_strip(raw))


def with_page_meta(df: DataFrame, html_col: str, title: str = "title", author: str = "author", date: str = "published_date") -> DataFrame:
    """B1: ``df`` plus title, author and date of its pages.

    Title: ``og:title`` when its content is non-empty, else the ``<title>``
    text; NULL when neither exists (callers default to ``Untitled``, and treat
    an empty result the same way).  Author: ``article:author`` over
    ``name=author`` (each only when non-empty).  Date: ``article:published_time``;
    if that is missing or blank, ``name=date``; a blank published_time with no
    ``name=date`` tag gives ''.  All stripped.

    Tags, raw values, decoded and stripped ones are named columns of their
    own, so each pass is one expression of the plan.
    """
    title_re = rf"(?is)<title{END}[^>]*>(.*?)</title\s*>"
    keep = [c for c in df.columns if c not in (title, author, date)]
    m = {k: F.col(f"__{k}") for k in (*META_TAGS, "title")}
    df = df.withColumn("__page", metadata_source(F.col(html_col)))
    page = F.col("__page")
    df = df.select(*keep, *[_meta_tag(page, *v).alias(f"__{k}") for k, v in META_TAGS.items()],
                   F.when(page.rlike(title_re), F.regexp_extract(page, title_re, 1)).alias("__title"))
    df = df.select(*keep, *[_content(m[k]).alias(f"__{k}") for k in META_TAGS], "__title")
    df = df.select(*keep, *[decode_references(c).alias(f"__{k}") for k, c in m.items()])
    df = df.select(*keep, *[_truthy_strip(m[k]).alias(f"__{k}") for k in META_TAGS], ws_strip(m["title"]).alias("__title"))
    return df.select(*keep, F.coalesce(m["og_title"], m["title"]).alias(title), F.coalesce(m["article_author"], m["author"]).alias(author),
                     F.when(F.coalesce(m["published"], F.lit("")) != "", m["published"]).otherwise(F.coalesce(m["date"], m["published"])).alias(date))

"""Page extraction job: metadata, main text, extractor choice, word count.

``regex_safe`` marks the unambiguous pages (the common case), which stay in
Catalyst; the rest (nested containers, unclosed containers,
``.content``/``#content`` containers, unusual entities) go through a small
standard-library ``html.parser`` walk in a pandas UDF, one Arrow batch at a
time.  Pages are scanned once and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from broadsheet.functions import html as H
from broadsheet.functions.text import normalize_whitespace, word_count

# Void elements of the HTML tree builder (never hold children).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image",
        "isindex", "keygen", "menuitem", "nextid", "spacer"}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _TreeBuilder(HTMLParser):
    """Minimal tree: start tags open nodes, end tags close the nearest open
    node of that name (unmatched end tags are ignored), text is merged into
    one string between tags, comments and declarations are skipped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("[document]", {}, None)
        self.cur = self.root
        self.buf: list[str] = []

    def _flush(self):
        if self.buf:
            self.cur.children.append("".join(self.buf))
            self.buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self._flush()
        self.cur.children.append(_Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        self._flush()
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n is not self.root:
            self.cur = n.parent

    def handle_data(self, data):
        self.buf.append(data)

    def close(self):
        super().close()
        self._flush()


def _walk(node):
    """Elements in document order, with a stack of their own: nesting may be deeper than Python's."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, _Node))


def _texts(node):
    """Stripped non-empty strings below a node in document order."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if s := n.strip():
                out.append(s)
        else:
            stack.extend(reversed(n.children))
    return out


def parse_main_text(html: str) -> str:
    """B2 on the parser path (one page)."""
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    for n in list(_walk(b.root)):
        if n.tag in H.REMOVED_TAGS and n.parent is not None:
            n.parent.children = [c for c in n.parent.children if c is not n]
    nodes = list(_walk(b.root))
    pick = next((n for n in nodes if n.tag == "article"), None)
    pick = pick or next((n for n in nodes if n.tag == "main"), None)
    pick = pick or next((n for n in nodes if "content" in n.attrs.get("class", "").split()), None)
    pick = pick or next((n for n in nodes if n.attrs.get("id") == "content"), None)
    pick = pick or next((n for n in nodes if n.tag == "body"), None)
    pick = pick or b.root
    return " ".join(" ".join(_texts(pick)).split())


@F.pandas_udf(StringType())
def parser_text(html: pd.Series) -> pd.Series:
    """The parser path over an Arrow batch; null (a page that does not need it) stays null."""
    return html.map(lambda h: None if h is None else parse_main_text(h))


def with_main_text(pages: DataFrame, html_col: str = "html", out: str = "fallback_text") -> DataFrame:
    """B2: add the fallback extractor's text for every page, in one pass over the pages.

    Regex-safe pages stay in Catalyst; only the HTML of the others is sent to
    Python (null stands for the rest).
    """
    p = pages.withColumn("_s", H.strip_removed(F.col(html_col))).withColumn("_tokens", H.structure_tokens(F.col(html_col)))
    p = p.withColumn("_safe", F.coalesce(H.regex_safe(F.col(html_col), F.col("_s"), F.col("_tokens")), F.lit(True)))
    fast = F.when(F.col("_safe"), H.container_text("_s"))
    slow = parser_text(F.when(~F.col("_safe"), F.col(html_col)))
    return p.withColumn("_slow", slow).withColumn(out, F.when(F.col("_safe"), fast).otherwise(F.col("_slow"))).drop("_s", "_tokens", "_safe", "_slow")


def extract_pages(pages: DataFrame, html_col: str = "html",
                  primary: Callable[[Column], Column] | None = None) -> DataFrame:
    """title/author/published_date, text, word_count for each page.

    ``primary`` is an optional column function for a preferred extractor; its
    result is used unless NULL or shorter than 100 characters once stripped,
    in which case the fallback (B2) text is used.  With none configured every
    page uses B2.  Empty pages give text '' and 0 words; titles default to
    ``Untitled``.
    """
    df = with_main_text(pages, html_col, "_fallback")
    if primary is not None:
        prim = primary(F.col(html_col))
        chosen = F.when(prim.isNull() | (F.length(F.trim(prim)) < 100), F.col("_fallback")).otherwise(prim)
    else:
        chosen = F.col("_fallback")
    df = H.with_page_meta(df.withColumn("_chosen", chosen), html_col)
    return (df.withColumn("text", F.coalesce(normalize_whitespace(F.col("_chosen")), F.lit("")))
            .withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")))
            .withColumn("word_count", word_count(F.col("text")))
            .drop("_fallback", "_chosen"))

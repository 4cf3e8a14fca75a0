"""URL column functions: canonical form, hash, feed heuristic.

The canonical form follows the standard library's split/unsplit rules exactly
(scheme only if it is all scheme characters, netloc after ``//`` up to
``/?#``, ``;params`` of the last segment for the schemes that use them) and is
written with Catalyst string functions only, so it codegens and never raises.
``parse_url`` is avoided on purpose: it throws under ANSI mode on bad input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query keys dropped by canonicalisation (compared lower-cased).
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term",
                   "utm_content", "ref", "source", "fbclid", "gclid"]

# The standard library's scheme lists.
USES_PARAMS = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp",
               "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel"]
USES_NETLOC = ["", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais",
               "file", "mms", "https", "shttp", "snews", "prospero", "rtsp",
               "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git",
               "git+ssh", "ws", "wss", "itms-services"]

# One pass splits scheme / netloc / path / query (the fragment is dropped):
# scheme only when everything before the first ':' is scheme characters,
# netloc only after '//', path up to the first '?' or '#'.
SPLIT_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _clean(x) -> Column:
    u = F.regexp_replace(_c(x), r"^[\x{00}-\x{20}]+", "")
    return F.regexp_replace(u, r"[\t\r\n]", "")


def _strip_params(scheme: Column, path: Column) -> Column:
    """Drop ``;params`` of the last path segment for schemes that use them."""
    no_params = (F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/[^;]*)", 1))
                 .otherwise(F.substring_index(path, ";", 1)))
    return F.when(scheme.isin(USES_PARAMS) & path.contains(";"), no_params).otherwise(path)


def url_path(x) -> Column:
    """Params-free path of a URL (what a feed-URL test looks at)."""
    u = _clean(x)
    return _strip_params(F.lower(F.regexp_extract(u, SPLIT_RE, 1)), F.regexp_extract(u, SPLIT_RE, 3))


def with_normalized_url(df: DataFrame, url_col: str, out: str = "url_norm") -> DataFrame:
    """Add the canonical URL as column ``out``.

    Written as staged projections over named intermediate columns: each
    regex runs once per row and the expression size stays linear (a single
    nested Column would repeat sub-expressions at every step).
    """
    t = "__u_"
    u = _clean(F.col(url_col))
    df = df.withColumn(t + "u", u)
    df = df.withColumns({
        t + "scheme": F.lower(F.regexp_extract(F.col(t + "u"), SPLIT_RE, 1)),
        t + "netloc": F.lower(F.regexp_extract(F.col(t + "u"), SPLIT_RE, 2)),
        t + "path": F.regexp_extract(F.col(t + "u"), SPLIT_RE, 3),
        t + "query": F.regexp_extract(F.col(t + "u"), SPLIT_RE, 4),
    })
    scheme, nl = F.col(t + "scheme"), F.col(t + "netloc")
    path = _strip_params(scheme, F.col(t + "path"))
    df = df.withColumns({
        t + "nl": (F.when((scheme == "http") & nl.endswith(":80"), F.expr(f"substring({t}netloc, 1, length({t}netloc) - 3)"))
                   .when((scheme == "https") & nl.endswith(":443"), F.expr(f"substring({t}netloc, 1, length({t}netloc) - 4)"))
                   .otherwise(nl)),
        t + "p1": path,
    })
    p1 = F.col(t + "p1")
    kept = F.filter(F.array_sort(F.split(F.col(t + "query"), "&")),
                    lambda q: (F.instr(q, "=") > 0) & ~F.lower(F.substring_index(q, "=", 1)).isin(TRACKING_PARAMS))
    df = df.withColumns({
        t + "p2": F.when((p1 != "/") & p1.endswith("/"), F.regexp_replace(p1, "/+$", "")).otherwise(p1),
        t + "q2": F.array_join(kept, "&"),
    })
    p2, q2, nl2 = F.col(t + "p2"), F.col(t + "q2"), F.col(t + "nl")
    body = (F.when(nl2 != "", F.concat(F.lit("//"), nl2,
                                       F.when((p2 != "") & ~p2.startswith("/"), F.concat(F.lit("/"), p2)).otherwise(p2)))
            .when(p2.startswith("//"), F.concat(F.lit("//"), p2))
            .when((scheme != "") & scheme.isin(USES_NETLOC) & ((p2 == "") | p2.startswith("/")),
                  F.concat(F.lit("//"), p2))
            .otherwise(p2))
    norm = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), body,
                    F.when(q2 != "", F.concat(F.lit("?"), q2)).otherwise(F.lit("")))
    df = df.withColumn(out, norm)
    return df.drop(*[c for c in df.columns if c.startswith(t)])


def with_url_hash(df: DataFrame, url_col: str, out: str = "url_hash") -> DataFrame:
    """Add the sha-256 hex of the canonical URL as column ``out``."""
    tmp = "__url_norm"
    return with_normalized_url(df, url_col, tmp).withColumn(out, F.sha2(F.col(tmp), 256)).drop(tmp)


def is_feed_url(x) -> Column:
    """A2: lower-cased path contains a feed marker (plain substring test).

    ``/feeds/``, ``feed.xml`` ... are implied by ``/feed``, ``.xml`` and so on,
    so the five short markers decide it.
    """
    path = F.lower(url_path(x))
    return path.rlike(r"/feed|/rss|/atom|\.rss|\.atom|\.xml")


def url_host(x) -> Column:
    """Lower-cased netloc (used to group pages into per-host feeds)."""
    return F.lower(F.regexp_extract(_clean(x), SPLIT_RE, 2))

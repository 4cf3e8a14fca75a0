"""Text column functions: whitespace, word counts, hashes, slugs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 29 code points Python's ``\s`` / ``str.split()`` treat as
# whitespace, written as one character class that Java regex and RE2 read the
# same way (Java's own ``\s`` misses 23 of them).
WS_CLASS = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WS_RUN = WS_CLASS + "+"

# The same code points as Spark's columns use them.  Java asks the ranges of a
# class one after the other, for every character, and long chains of them are
# not compiled together (ten times the time).  Single characters below 256 are
# one table lookup, and the others stand behind one range that most text fails.
_JAVA_WS = (r"\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}"
            r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]")
JAVA_WS_CLASS = f"[{_JAVA_WS}]"
JAVA_WS_RUN = JAVA_WS_CLASS + "+"


def java_not(chars: str = "") -> str:
    """Java class of everything but whitespace and some more characters."""
    return f"[^{chars}{_JAVA_WS}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ws_strip(x) -> Column:
    """Strip Unicode whitespace at both ends (Python ``str.strip()``)."""
    return F.regexp_replace(_c(x), "^" + JAVA_WS_RUN + "|" + JAVA_WS_RUN + "$", "")


def normalize_whitespace(x) -> Column:
    """Every Unicode whitespace run becomes one space, then trim."""
    return F.trim(F.regexp_replace(_c(x), JAVA_WS_RUN, " "))


NON_WS_RUN = java_not() + "+"


def word_count(x) -> Column:
    """Number of whitespace-separated tokens (0 for empty text).

    One regex pass counting maximal non-whitespace runs.
    """
    return F.coalesce(F.regexp_count(_c(x), F.lit(NON_WS_RUN)), F.lit(0)).cast("int")


def normalize_text(x) -> Column:
    """D3: lower case, collapse whitespace, trim."""
    return normalize_whitespace(F.lower(_c(x)))


def content_hash(x) -> Column:
    """Sha-256 hex of the canonical text."""
    return F.sha2(normalize_text(x), 256)


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """NFKD then drop non-ASCII code points (Spark has no Unicode normaliser).

    Arrow-batched; the only Python step in slug building.
    """
    return (s.str.normalize("NFKD")
             .str.encode("ascii", errors="ignore")
             .str.decode("ascii"))


def library_slug(x, max_length: int = 50) -> Column:
    """ASCII slug for storage keys, cut at a ``-`` boundary, ``untitled`` if empty."""
    s = F.regexp_replace(F.lower(ascii_fold(_c(x))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    head = F.substring(s, 1, max_length)
    cut = F.when(F.instr(head, "-") > 0, F.regexp_extract(head, "^(.*)-", 1)).otherwise(head)
    s = F.when(F.length(s) > max_length, cut).otherwise(s)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def story_slug(x) -> Column:
    """Story id slug; keeps a-z, 0-9 and CJK ideographs, first 60 chars.

    Returns '' when nothing is left; the caller supplies ``item-{i}``.
    """
    s = F.lower(ws_strip(_c(x)))
    s = F.regexp_replace(s, "[^a-z0-9\\x{4e00}-\\x{9fff}]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.substring(s, 1, 60)


def thousands(x) -> Column:
    """Python ``f"{n:,}"`` for integers: ``1,234,567``."""
    return F.format_number(_c(x).cast("long"), 0)

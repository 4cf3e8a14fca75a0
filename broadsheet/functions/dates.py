"""Date column functions: free-form date strings and day ages (C2, 2.K.4).

A date string is cut to 19 characters and must then match one of
``%Y-%m-%d``, ``%Y-%m-%dT%H:%M:%S`` or ``%Y-%m-%dT%H:%M:%SZ`` in full, with the
standard library's field rules: non-padded month/day/hour/minute/second are
accepted, a day may be `` 5`` (space + digit), letters are case-insensitive,
second 60/61 and impossible calendar days fail.  The guard is a regex; the
value is built with ``try_make_timestamp_ntz`` so nothing throws under ANSI.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_Y = r"(\d{4})"
_M = r"(1[0-2]|0[1-9]|[1-9])"
_D = r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
_H = r"(2[0-3]|[01]\d|\d)"
_MI = r"([0-5]\d|\d)"
_S = r"([0-5]\d|\d)"
# date, or date 'T' time with an optional 'Z' (case-insensitive), whole string
LOOSE_RE = "(?i)^" + _Y + "-" + _M + "-" + _D + "(?:T" + _H + ":" + _MI + ":" + _S + "Z?)?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_loose_date(x) -> Column:
    """Parse a free date string to TIMESTAMP_NTZ, NULL when unparsable."""
    s = F.substring(_c(x), 1, 19)

    def g(i):
        return F.trim(F.regexp_extract(s, LOOSE_RE, i))

    def t(i):
        return F.coalesce(F.nullif(g(i), F.lit("")).cast("int"), F.lit(0))

    ts = F.try_make_timestamp_ntz(g(1).cast("int"), g(2).cast("int"), g(3).cast("int"), t(4), t(5), t(6))
    return F.when(s.rlike(LOOSE_RE) & (g(1).cast("int") >= 1), ts)


def days_between(start, end) -> Column:
    """Whole days from ``start`` to ``end``, floored (negative in the future)."""
    secs = F.timestamp_diff("SECOND", _c(start), _c(end))
    return F.floor(secs / F.lit(86400.0))


def freshness_score(date_str, as_of) -> Column:
    """5 for <= 1 day old (future included), 4 / 3 / 2 for <= 3 / 7 / 30, else 1.

    Absent, empty or unparsable dates score 2.0.  ``as_of`` is a parameter, so
    the plan never reads the clock.
    """
    dt = parse_loose_date(date_str)
    age = days_between(dt, as_of)
    return (F.when(dt.isNull(), F.lit(2.0))
            .when(age <= 1, F.lit(5.0))
            .when(age <= 3, F.lit(4.0))
            .when(age <= 7, F.lit(3.0))
            .when(age <= 30, F.lit(2.0))
            .otherwise(F.lit(1.0)))

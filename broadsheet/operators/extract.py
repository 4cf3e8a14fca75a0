"""Extraction-side projections: storage keys, tags, source typing, quality gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import library_slug

# Default tag list and the minimum word count of the gate.
DEFAULT_TAGS = ["reading-list"]
MIN_WORDS = 50
REJECT_REASON = "Too little content extracted"


def storage_path(title, fetched_at) -> Column:
    """``YYYY/MM/<slug>-HHMMSS`` (the row's true key stays ``url_hash``)."""
    t = F.col(fetched_at) if isinstance(fetched_at, str) else fetched_at
    return F.concat(F.date_format(t, "yyyy/MM/"), library_slug(title), F.lit("-"), F.date_format(t, "HHmmss"))


def default_tags(tags, default=DEFAULT_TAGS) -> Column:
    """Explicit tags replace the default list; none given means the default."""
    t = F.col(tags) if isinstance(tags, str) else tags
    return F.when(F.size(F.coalesce(t, F.array())) > 0, t).otherwise(
        F.array(*[F.lit(x) for x in default]))


def source_type(n_entries) -> Column:
    """``rss`` when the row's source line stands for more than one URL, else ``manual``.

    ``n_entries`` is carried by the expansion, so no count is joined back.
    """
    n = F.col(n_entries) if isinstance(n_entries, str) else n_entries
    return F.when(n > 1, "rss").otherwise("manual")


def quality_gate(word_count) -> Column:
    """Rejection reason for pages with fewer than 50 words, else NULL."""
    w = F.col(word_count) if isinstance(word_count, str) else word_count
    return F.when(w < MIN_WORDS, F.lit(REJECT_REASON))

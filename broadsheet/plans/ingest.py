"""Batch ingest with a per-row outcome log (I1), its dry run (I2) and run counts.

Plan: sources (A1) -> expansion (A4) -> raw pages by URL (A9) -> extraction
(B1-B5, once per distinct URL) -> quality gate (B6) -> hashes (D1-D4) ->
history check (D7) -> in-batch first-wins dedup (D8) -> storage key, tags,
source type, summary (B7-B11, F1) -> library + seen-log sinks (G1, D10).

Only ``(ord, url_hash, content_hash)`` travels through the dedup shuffles;
text and HTML are joined back by key afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import content_hash
from broadsheet.functions.urls import with_url_hash
from broadsheet.operators import dedup as DD
from broadsheet.operators import extract as X
from broadsheet.operators.bloom import buckets_for, key_bitmaps, may_hold
from broadsheet.operators.pages import extract_pages
from broadsheet.operators.skew import lookup_join
from broadsheet.operators.summarize import mock_summary
from broadsheet.session import cut_lineage
from broadsheet.sinks.library import library_rows, write_library
from broadsheet.sinks.seen import append_seen, seen_records


@dataclass
class IngestResult:
    outcomes: DataFrame      # url, ord, success, skipped, error, title, stored_path
    articles: DataFrame      # library rows of the accepted articles
    seen: DataFrame          # seen records of the accepted articles


# A table of page keys up to this size may be broadcast to the page scan.
BROADCAST_BYTES = 32 << 20


def wanted_pages(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """``(url, html)`` of the wanted URLs, each from its first page row.

    The first row per URL is found on ``(url, ord)`` alone, for wanted URLs
    only.  Those keys are materialised and measured: up to ``BROADCAST_BYTES``
    they are broadcast to the page scan.  Beyond, bitmaps of the keys' hashes
    are (``operators.bloom``, of bounded size): pages that are not wanted leave
    at the scan, and only the rest meets the keys in a shuffle join.
    """
    keys = cut_lineage(pages.select("url", "ord").join(urls.select("url").distinct(), "url", "left_semi")
                       .groupBy("url").agg(F.min("ord").alias("ord")))
    n, size = keys.agg(F.count(F.lit(1)), F.sum(F.octet_length("url") + 32)).first()
    rows = pages.select("url", "ord", "html")
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys), ["url", "ord"]).select("url", "html")
    buckets = buckets_for(n)
    rows = may_hold(rows, cut_lineage(key_bitmaps(keys, ["url", "ord"], buckets)), ["url", "ord"], buckets)
    return rows.join(keys.hint("shuffle_hash"), ["url", "ord"]).select("url", "html")


def ingest_batch(expanded: DataFrame, pages: DataFrame, seen_latest: DataFrame | None,
                 fetched_at: str, batch_id: int = 0, default_tags=X.DEFAULT_TAGS,
                 force_col: str | None = None, seen_log: DataFrame | None = None,
                 seen_lookup: Callable[[DataFrame], DataFrame | None] | None = None) -> IngestResult:
    """I1 (without writing): outcome per expanded URL plus the rows to store.

    ``expanded``: ``(ord, source_url, url, n_entries)`` from :func:`expand_sources`;
    ``pages``: ``(ord, url, html)``; ``seen_latest``: resolved history (or
    None for a first run); alternatively ``seen_log``: raw seen records with a
    ``pos`` column, resolved only around this batch's keys
    (:func:`seen_latest_for`), or ``seen_lookup``: the resolved history around
    some keys (``SeenStore.lookup``).  ``fetched_at`` is the run's timestamp parameter.
    """
    expanded = cut_lineage(expanded)  # read three times; the feeds are parsed once
    got = wanted_pages(pages, expanded).filter(F.col("html").isNotNull())
    ext = (extract_pages(got, "html")
           .select("url", "title", "author", "published_date", "text", "word_count"))
    # extracted once per URL and materialised; the text stays here until rows are accepted
    ext = cut_lineage(ext.dropDuplicates(["url"]).withColumn("content_hash", content_hash(F.col("text"))))
    per_url = expanded.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    facts = ext.select("url", "title", "author", "published_date", "word_count", "content_hash",
                       F.col("text").isNotNull().alias("has_text"), (F.coalesce("text", F.lit("")) != "").alias("has_content"))
    typed = expanded.withColumn("source_type", X.source_type("n_entries"))
    rows = lookup_join(typed, facts.join(per_url, "url"), "url", "n", "left")
    rows = cut_lineage(with_url_hash(rows, "url", "url_hash"))
    fetch_error = ~F.coalesce("has_text", F.lit(False))
    gate = X.quality_gate(F.col("word_count"))
    cand = rows.filter(~fetch_error & gate.isNull())
    forced = F.col(force_col) if force_col else F.lit(False)
    cand = cand.withColumn("_force", F.coalesce(forced, F.lit(False)))
    keys = cand.select("ord", "url_hash", "content_hash", F.col("has_content").alias("content"), "_force")
    if seen_latest is None and seen_log is not None:
        # resolved once, for the lookup by URL and the one by content
        seen_latest = cut_lineage(DD.seen_latest_for(seen_log, keys).select("url_hash", "first_pos", "content_hash", "title"))
    if seen_latest is None and seen_lookup is not None:
        seen_latest = seen_lookup(keys.select("url_hash", "content_hash"))
    if seen_latest is not None:
        again = keys.filter("_force")
        unseen = DD.drop_seen(keys.filter(~F.col("_force")), seen_latest, forced=again if force_col else None).unionByName(again)
    else:
        unseen = keys
    verdict = DD.greedy_dedup(DD.dedup_keys(unseen, extra=("_force",)), force_col="_force" if force_col else None)
    ts = F.lit(fetched_at).cast("timestamp_ntz")
    out = (rows.join(verdict, "ord", "left")
           .withColumn("fetched_at", ts)
           .withColumn("stored_path", X.storage_path(F.col("title"), ts)))
    success = F.coalesce(F.col("keep"), F.lit(False))
    outcomes = out.select(
        "ord", "url",
        success.alias("success"),
        (~fetch_error & gate.isNull() & ~success).alias("skipped"),
        F.when(fetch_error, F.concat(F.lit("Failed to fetch URL: "), F.col("url")))
        .when(gate.isNotNull(), gate).alias("error"),
        F.when(success, F.col("stored_path")).alias("stored_path"),
        F.when(~fetch_error & gate.isNull(), F.col("title")).alias("title"))
    accepted = (out.filter(success).join(ext.select("url", "text"), "url")
                .withColumn("tags", X.default_tags(F.lit(None).cast("array<string>"), default_tags))
                .withColumn("source", F.col("source_type"))
                .withColumn("content", F.col("text"))
                .withColumn("summary", mock_summary(F.col("text"), F.col("title")))
                .withColumn("batch_id", F.lit(batch_id)))
    return IngestResult(outcomes, library_rows(accepted), seen_records(accepted))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Ingested / skipped / errors counts (error = neither success nor skipped)."""
    return outcomes.agg(F.count_if("success").alias("ingested"), F.count_if("skipped").alias("skipped"),
                        F.count_if(~F.col("success") & ~F.col("skipped")).alias("errors"))


def dry_run(pages: DataFrame, seen_latest: DataFrame | None, default_tags=X.DEFAULT_TAGS,
            force_col: str | None = None) -> DataFrame:
    """Single-URL ingest of each page without sinks: what would be written.

    Single mode warns (instead of rejecting) under 50 words.  A duplicate of
    history is reported with its reason and would not be stored, unless the
    row is forced: then it is stored and not checked.
    """
    e = extract_pages(pages, "html")
    e = with_url_hash(e, "url", "url_hash").withColumn("content_hash", content_hash(F.col("text")))
    forced = F.coalesce(F.col(force_col), F.lit(False)) if force_col else F.lit(False)
    e = e.withColumn("forced", forced)
    if seen_latest is not None:
        e = DD.duplicate_lookup(e, seen_latest, "text")
    else:
        e = e.withColumn("is_dup", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    return e.select("ord", "url", "title", F.coalesce("author", F.lit("Unknown")).alias("author"),
                    "word_count", F.array_join(F.array(*[F.lit(t) for t in default_tags]), ", ").alias("tags"),
                    F.substring("url_hash", 1, 16).alias("url_hash16"),
                    F.substring("content_hash", 1, 16).alias("content_hash16"),
                    (F.col("word_count") < X.MIN_WORDS).alias("low_content_warning"), "forced",
                    (F.col("is_dup") & ~F.col("forced")).alias("is_dup"),
                    F.when(~F.col("forced"), F.col("reason")).alias("reason"))


def write_batch(result: IngestResult, library_path: str, seen_path: str) -> None:
    """Sinks of I1: library (G1) and seen log (D10); both keyed, appended."""
    write_library(result.articles, library_path)
    append_seen(result.seen, seen_path)

"""Explicit schemas of the engine's record types (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


SEEN = T.StructType([
    _f("url", S, False), _f("url_hash", S, False), _f("content_hash", S, False),
    _f("title", S, False), _f("fetched_at", TS, False), _f("stored_path", S, False),
    _f("source", S, False),
])

ARTICLE = T.StructType([
    _f("title", S, False), _f("author", S), _f("published_date", S), _f("url", S, False),
    _f("url_hash", S, False), _f("content_hash", S, False), _f("fetched_at", TS, False),
    _f("word_count", I, False), _f("tags", T.ArrayType(S, False)), _f("source", S, False),
    _f("content", S), _f("summary", S), _f("year", S), _f("month", S),
])

EXTRACTED = T.StructType([
    _f("title", S, False), _f("author", S), _f("published_date", S), _f("text", S, False),
    _f("word_count", I, False),
])

FEED_ITEM = T.StructType([_f("title", S, False), _f("link", S, False), _f("published", S)])

INGEST_LOG = T.StructType([
    _f("url", S, False), _f("success", B, False), _f("skipped", B, False), _f("error", S),
    _f("stored_path", S), _f("title", S),
])

ITEM = T.StructType([
    _f("title", S, False), _f("url", S, False), _f("source", S), _f("date", S),
    _f("snippet", S), _f("content", S), _f("author", S), _f("tags", T.ArrayType(S)),
])

SCORES = T.StructType([_f("importance", I), _f("credibility", I), _f("freshness", I)])

STORY = T.StructType([
    _f("id", S), _f("title", S), _f("subtitle", S), _f("url", S), _f("source", S), _f("date", S),
    _f("section", S), _f("one_liner", S), _f("bullets", T.ArrayType(S)), _f("why_it_matters", S),
    _f("action_items", T.ArrayType(S)), _f("read_time_min", I), _f("scores", SCORES),
    _f("tags", T.ArrayType(S)), _f("notes", S),
])

SECTION_ITEM = T.StructType([
    _f("ref_id", S), _f("title", S), _f("url", S), _f("source", S), _f("date", S),
    _f("one_liner", S), _f("scores", SCORES), _f("tags", T.ArrayType(S)),
])

SECTION = T.StructType([_f("name", S), _f("items", T.ArrayType(SECTION_ITEM))])

SEARCH_SUMMARY = T.StructType([
    _f("query_hint", S), _f("matching_tags", T.ArrayType(S)), _f("top_refs", T.ArrayType(S)),
    _f("one_sentence_map", S),
])

DUPLICATE = T.StructType([_f("title", S), _f("url", S), _f("merged_into", S), _f("reason", S)])

STATS = T.StructType([
    _f("items_in", I), _f("items_kept", I), _f("top_stories_count", I), _f("duplicates_count", I),
])

DIGEST = T.StructType([
    _f("schema_version", S), _f("generated_at", S), _f("stats", STATS),
    _f("top_stories", T.ArrayType(STORY)), _f("sections", T.ArrayType(SECTION)),
    _f("tag_index", T.MapType(S, T.ArrayType(S))),
    _f("search_summaries", T.ArrayType(SEARCH_SUMMARY)), _f("duplicates", T.ArrayType(DUPLICATE)),
])

"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Every query reads the provided tables (through the stand-in views of
``broadsheet.sources.tables``) over their whole extent; the matching DuckDB SQL
lives in ``broadsheet.plans.oracle_sql`` under the same key and with the same
column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import dates as D
from broadsheet.functions import text as TX
from broadsheet.functions import urls as U
from broadsheet.operators import rank as R
from broadsheet.schemas import DIGEST
from broadsheet.session import cut_lineage
from broadsheet.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All free text of the provided tables as (tbl, id, text); ids are text, a conversation's turn has its own."""
    docs = S.read_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("id"), "text")
    conv = S.read_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("tbl"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    bench = S.read_table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("tbl"), F.col("item_id").cast("string").alias("id"), "text")
    return docs.unionByName(conv).unionByName(bench)


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.articles(spark, sf_dir).select(F.lit("art").alias("tbl"), "ord", "url")
    p = S.pages(spark, sf_dir).select(F.lit("pg").alias("tbl"), "ord", "url")
    return a.unionByName(p)


# --------------------------------------------------------------------------- C

@query("pre_rank")
def q_pre_rank(spark, sf_dir):
    """C5 (flagship): score every article, keep the top 30 by score then position."""
    top = R.pre_rank(S.articles(spark, sf_dir), as_of=S.AS_OF, top_k=30)
    return top.select("rank", "ord", "title", "url", "source", "date",
                      "source_weight", "freshness", "length_score", "score")


@query("source_weight")
def q_source_weight(spark, sf_dir):
    """C1 over every article."""
    a = S.articles(spark, sf_dir)
    return a.select("ord", R.source_weight(F.col("source"), F.col("url")).alias("source_weight"))


@query("freshness")
def q_freshness(spark, sf_dir):
    """C2 over every article date."""
    a = S.articles(spark, sf_dir)
    return a.select("ord", "date",
                    D.freshness_score(F.col("date"), F.lit(S.AS_OF).cast("timestamp_ntz")).alias("freshness"))


@query("length_score")
def q_length_score(spark, sf_dir):
    """C3 over every article (content, no snippet)."""
    a = S.articles(spark, sf_dir)
    return a.select("ord", R.length_score(F.col("content")).alias("length_score"))


# --------------------------------------------------------------------- B4/B5/D

@query("ws_norm")
def q_ws_norm(spark, sf_dir):
    """B4 over all text columns."""
    return _texts(spark, sf_dir).select("tbl", "id", TX.normalize_whitespace("text").alias("norm"))


@query("word_count")
def q_word_count(spark, sf_dir):
    """B5 over all text columns."""
    return _texts(spark, sf_dir).select("tbl", "id", TX.word_count("text").alias("word_count"))


@query("content_hash")
def q_content_hash(spark, sf_dir):
    """D3+D4 over all text columns."""
    return _texts(spark, sf_dir).select("tbl", "id", TX.content_hash("text").alias("content_hash"))


@query("url_norm")
def q_url_norm(spark, sf_dir):
    """D1 over article and page URLs."""
    return U.with_normalized_url(_urls(spark, sf_dir), "url", "url_norm").select("tbl", "ord", "url", "url_norm")


@query("url_hash")
def q_url_hash(spark, sf_dir):
    """D2 over article and page URLs."""
    return U.with_url_hash(_urls(spark, sf_dir), "url", "url_hash").select("tbl", "ord", "url_hash")


@query("feed_url_class")
def q_feed_url_class(spark, sf_dir):
    """A2 over article and page URLs."""
    return _urls(spark, sf_dir).select("tbl", "ord", U.is_feed_url("url").alias("is_feed"))


# ---------------------------------------------------------------- A6 / D5-D11

from broadsheet.functions.text import story_slug  # noqa: E402
from broadsheet.operators import dedup as DD  # noqa: E402
from broadsheet.operators import extract as X  # noqa: E402
from broadsheet.sinks.seen import seen_records, to_jsonl_lines  # noqa: E402


def _keyed(spark, sf_dir) -> DataFrame:
    """Articles with their url and content hashes."""
    return (U.with_url_hash(S.articles(spark, sf_dir), "url", "url_hash")
            .withColumn("content_hash", TX.content_hash("content")))


def _keys(spark, sf_dir) -> DataFrame:
    """Narrow dedup keys of every article (no text), materialised once.

    ``content`` becomes a has-content flag; the dedup operators accept
    either.  Every dedup query reads this small table several times.
    """
    k = _keyed(spark, sf_dir).select("ord", "url", "title", "source", "fetched_at", "date", "tags",
                                     "url_hash", "content_hash",
                                     (F.coalesce(F.col("content"), F.lit("")) != "").alias("content"),
                                     F.length("content").alias("n_chars"))
    return cut_lineage(k)


def _stored_type():
    """Source type of a stand-in stored record (ingest writes it with the row): every fifth was added by hand."""
    return F.when(F.pmod("ord", F.lit(5)) == 4, "manual").otherwise("rss")


def _as_seen(keyed: DataFrame) -> DataFrame:
    """Seen records (D10 builder) for article rows, positioned by ord."""
    rows = (keyed.withColumn("source_type", _stored_type())
            .withColumn("stored_path", X.storage_path(F.col("title"), F.col("fetched_at")))
            .withColumn("batch_id", F.lit(0)))
    recs = seen_records(rows)
    return recs.withColumn("pos", F.col("pos.ord"))


def _history_latest(keyed: DataFrame) -> DataFrame:
    hist, _ = S.history_split(keyed)
    return DD.seen_latest(_as_seen(hist))


@query("seen_latest")
def q_seen_latest(spark, sf_dir):
    """Every article written to a JSONL seen log in order, parsed back and
    resolved (last record per url hash wins, at its first position)."""
    lines = to_jsonl_lines(_as_seen(_keys(spark, sf_dir)))
    latest = DD.seen_latest(DD.parse_seen_lines(lines))
    return latest.select("url_hash", "first_pos", "url", "content_hash", "title",
                         "fetched_at", "stored_path", "source")


@query("seen_content")
def q_seen_content(spark, sf_dir):
    """Content hashes of the latest history records."""
    return DD.seen_content_hashes(_history_latest(_keys(spark, sf_dir)))


@query("dup_lookup")
def q_dup_lookup(spark, sf_dir):
    """Duplicate verdict and reason for each new article against history."""
    keyed = _keys(spark, sf_dir)
    _, batch = S.history_split(keyed)
    out = DD.duplicate_lookup(batch.select("ord", "url_hash", "content_hash", "content"),
                              _history_latest(keyed))
    return out.select("ord", "is_dup", "reason")


@query("anti_seen")
def q_anti_seen(spark, sf_dir):
    """New articles whose URL and content are both unseen."""
    keyed = _keys(spark, sf_dir)
    _, batch = S.history_split(keyed)
    return DD.drop_seen(batch.select("ord", "url_hash", "content_hash", "content"),
                        _history_latest(keyed)).select("ord")


@query("greedy_dedup")
def q_greedy_dedup(spark, sf_dir):
    """Sequential first-wins dedup over url and content hash, all articles."""
    return DD.greedy_dedup(DD.dedup_keys(_keys(spark, sf_dir)))


@query("force_ingest")
def q_force_ingest(spark, sf_dir):
    """Refresh run over new articles; rows whose URL is in history but whose
    content changed are forced (admitted and recorded, the old content is
    forgotten from there on), the rest go through the history check (D7) and
    the in-batch dedup (D8)."""
    keyed = _keys(spark, sf_dir)
    _, batch = S.history_split(keyed)
    latest = _history_latest(keyed)
    b = (batch.select("ord", "url_hash", "content_hash", "content")
         .join(latest.select("url_hash", F.col("content_hash").alias("seen_content")), "url_hash", "left")
         .withColumn("forced", F.coalesce(F.col("seen_content") != F.col("content_hash"), F.lit(False))))
    unseen = DD.drop_seen(b.filter(~F.col("forced")), latest, forced=b.filter("forced"))
    cand = unseen.unionByName(b.filter("forced"))
    verdict = DD.greedy_dedup(DD.dedup_keys(cand, extra=("forced",)), force_col="forced")
    return (b.select("ord", "forced").join(verdict, "ord", "left")
            .select("ord", "forced", F.coalesce("keep", F.lit(False)).alias("keep")))


@query("event_merge")
def q_event_merge(spark, sf_dir):
    """Same-content articles merge into the most authoritative, longest,
    earliest one; each other member is a duplicates row."""
    a = (_keys(spark, sf_dir)
         .withColumn("source_weight", R.source_weight(F.col("source"), F.col("url")))
         .withColumn("story_id", F.coalesce(F.nullif(story_slug(F.col("title")), F.lit("")),
                                            F.concat(F.lit("item-"), F.col("ord").cast("string")))))
    return DD.event_merge(a)


@query("storage_path")
def q_storage_path(spark, sf_dir):
    """B9 (with B7 slug) for every article."""
    a = S.articles(spark, sf_dir)
    return a.select("ord", X.storage_path(F.col("title"), F.col("fetched_at")).alias("stored_path"))


@query("slug")
def q_slug(spark, sf_dir):
    """B7 library slug of every article title."""
    a = S.articles(spark, sf_dir).select(F.lit("art").alias("tbl"), "ord", "title")
    return a.select("tbl", "ord", TX.library_slug(F.col("title")).alias("slug"))


@query("story_id")
def q_story_id(spark, sf_dir):
    """B8 story id of every article title (``item-{ord}`` when empty)."""
    a = S.articles(spark, sf_dir)
    sid = F.coalesce(F.nullif(story_slug(F.col("title")), F.lit("")),
                     F.concat(F.lit("item-"), F.col("ord").cast("string")))
    return a.select("ord", sid.alias("story_id"))


@query("source_type")
def q_source_type(spark, sf_dir):
    """Source type of every URL the sources file expands to, by its source line."""
    return _expanded(spark, sf_dir).select("source_ord", "pos", "url", X.source_type("n_entries").alias("source_type"))


@query("tag_default")
def q_tag_default(spark, sf_dir):
    """Explicit tags (the language, given for non-English articles) or the default."""
    a = S.articles(spark, sf_dir)
    lang = F.col("tags")[0]
    given = F.when(lang != "en", F.array(lang)).otherwise(F.array().cast("array<string>"))
    return a.select("ord", F.array_join(X.default_tags(given), ",").alias("tags"))


# ------------------------------------------------------------------ B1-B3, B6

from broadsheet.functions import html as H  # noqa: E402
from broadsheet.operators import pages as P  # noqa: E402


@query("page_meta")
def q_page_meta(spark, sf_dir):
    """B1: title / author / published date of every page."""
    return H.with_page_meta(S.pages(spark, sf_dir), "html").select("ord", "title", "author", "published_date")


@query("page_text")
def q_page_text(spark, sf_dir):
    """B2: main text of every page (regex path, parser path where ambiguous)."""
    return P.with_main_text(S.pages(spark, sf_dir), "html", "text").select("ord", "text")


@query("page_extract")
def q_page_extract(spark, sf_dir):
    """B3 (+B5): extractor choice with the default configuration, title default, word count."""
    return P.extract_pages(S.pages(spark, sf_dir)).select("ord", "title", "text", "word_count")


@query("quality_gate")
def q_quality_gate(spark, sf_dir):
    """Pages under 50 words are rejected before dedup."""
    e = P.extract_pages(S.pages(spark, sf_dir))
    return e.select("ord", "word_count", X.quality_gate(F.col("word_count")).alias("error"))


# -------------------------------------------------------- F1-F3, E2, G2, A7, A8

from broadsheet.operators import summarize as SM  # noqa: E402
from broadsheet.plans import daily as DY  # noqa: E402
from broadsheet.sinks import library as LB  # noqa: E402

LIBRARY_DAY = "2024-01-01"


def _library(spark, sf_dir) -> DataFrame:
    """Every article as a library row, the way ingest stores it (summary included).

    Column pruning drops what a query does not read (most digest queries
    never touch ``summary``).
    """
    rows = (_keyed(spark, sf_dir).withColumn("author", F.lit(None).cast("string"))
            .withColumn("published_date", F.col("date"))
            .withColumn("word_count", TX.word_count("content"))
            .withColumn("source", _stored_type())
            .withColumn("summary", SM.mock_summary(F.col("content"), F.col("title")))
            .withColumn("stored_path", X.storage_path(F.col("title"), F.col("fetched_at"))))
    return LB.library_rows(rows, extra=("ord",))


@query("summary_parts")
def q_summary_parts(spark, sf_dir):
    """F1 pieces for every article: TL;DR, quote, word and sentence counts."""
    a = S.articles(spark, sf_dir)
    p = SM.summary_parts(F.col("content"))
    return a.select("ord", p["tldr"].alias("tldr"), p["quote"].alias("quote"),
                    p["n_words"].alias("n_words"), p["n_sentences"].alias("n_sentences"))


@query("summary_md")
def q_summary_md(spark, sf_dir):
    """the full heuristic Markdown summary of every article."""
    a = S.articles(spark, sf_dir)
    return a.select("ord", SM.mock_summary(F.col("content"), F.col("title")).alias("summary"))


@query("llm_requests")
def q_llm_requests(spark, sf_dir):
    """summary request rows (input cut at 15000 chars) for every article."""
    a = S.articles(spark, sf_dir)
    return a.select("ord", SM.summary_request(F.col("content")).alias("request"),
                    (F.length("content") > SM.MAX_INPUT_CHARS).alias("truncated"))


@query("llm_replies")
def q_llm_replies(spark, sf_dir):
    """summaries of all articles from a reply table (stand-in: first line as the reply, some with
    a heading of their own, some failed, some missing)."""
    a = _keyed(spark, sf_dir).select("ord", "title", "content").withColumn("key", F.col("ord"))
    kind = F.pmod("key", F.lit(7))
    first = F.substring_index(F.col("content"), "\n", 1)
    replies = a.filter(kind != 6).select(
        "key", F.when(kind == 1, F.concat(F.lit("# "), F.col("title"), F.lit("\n"), first)).when(kind != 5, first).alias("reply"),
        F.when(kind == 5, "timeout").alias("error"))
    out = SM.apply_replies(a.select("key", "ord", "title"), replies, "key")
    return out.select("ord", "summary", "summary_error", "pending")


@query("tldr")
def q_tldr(spark, sf_dir):
    """TL;DR section extracted from each article's stored summary."""
    a = S.articles(spark, sf_dir)
    md = SM.mock_summary(F.col("content"), F.col("title"))
    return a.select("ord", SM.tldr_section(md).alias("tldr"))


@query("daily_totals")
def q_daily_totals(spark, sf_dir):
    """Articles and words per fetch day over the whole library."""
    return DY.daily_totals(_library(spark, sf_dir))


@query("daily_digest")
def q_daily_digest(spark, sf_dir):
    """The daily Markdown digest lines for every fetch day in the library."""
    return DY.digest_lines(_library(spark, sf_dir), None, generated_at="2024-02-01T00:00:00")


@query("fetch_order")
def q_fetch_order(spark, sf_dir):
    """Library articles in fetch order within their day (position in the daily digest)."""
    rows = _library(spark, sf_dir).select(F.to_date("fetched_at").alias("day"), "fetched_at", "url_hash")
    return R.position_within(rows, "day", ["fetched_at", "url_hash"])


@query("library_for_date")
def q_library_for_date(spark, sf_dir):
    """Library rows fetched on one day (year/month pruning + date filter)."""
    lib = _library(spark, sf_dir)
    return LB.library_for_date(lib, LIBRARY_DAY).select("ord", "title", "url", "fetched_at", "word_count")


@query("library_stored")
def q_library_stored(spark, sf_dir):
    """G1 + A7: the library written as partitioned Parquet, then one day read back through partition filters."""
    import uuid

    from broadsheet.session import ensure_checkpoint_dir

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/library-{uuid.uuid4().hex}"
    LB.write_library(_library(spark, sf_dir), path)
    return LB.library_for_date(spark.read.parquet(path), LIBRARY_DAY).select("url_hash", "title", "url", "fetched_at", "word_count", "source")


@query("library_items")
def q_library_items(spark, sf_dir):
    """Library rows projected to digest items."""
    lib = _library(spark, sf_dir)
    return LB.library_items(lib).select("url_hash", "title", "url", "source", "date",
                                        F.array_join("tags", ",").alias("tags"))


# ------------------------------------------ digest document and its queries

from broadsheet.operators import digest as DG  # noqa: E402
from broadsheet.operators import search as SE  # noqa: E402

SEARCH_TERMS = ["src1", "OpenAI", " le ", "the", "zzz-none"]
FILTER_TAGS = ["all", "en", "src3", "no-such-tag"]


def _day_items(lib: DataFrame) -> DataFrame:
    """Library items (A8) of each fetch day, with their library position."""
    return lib.select(F.to_date("fetched_at").alias("day"), "ord", "title", "url", "source",
                   F.coalesce(F.nullif(F.col("published_date"), F.lit("")),
                              F.date_format("fetched_at", "yyyy-MM-dd")).alias("date"),
                   F.lit(None).cast("string").alias("snippet"), "content", "author", "tags")


def _digest_parts(spark, sf_dir):
    items = _day_items(_library(spark, sf_dir))
    ranked = DG.top_k_per_group(items, "day", S.AS_OF, 30)
    cards = DG.story_cards(ranked, "day")
    return items, ranked, cards


@query("story_cards")
def q_story_cards(spark, sf_dir):
    """F4 (C6): top-12 story cards of each day's digest."""
    _, _, cards = _digest_parts(spark, sf_dir)
    return cards.select("day", "rank", "id", "title", "subtitle", "url", "source", "date", "section",
                        "one_liner", F.array_join("bullets", "|").alias("bullets"), "read_time_min",
                        F.array_join("tags", ",").alias("tags"))


@query("sections")
def q_sections(spark, sf_dir):
    """Section items in first-appearance order, items in rank order."""
    _, _, cards = _digest_parts(spark, sf_dir)
    sec = DG.sections(cards, "day")
    return sec.select("day", "name", "first_rank", F.posexplode("items").alias("pos", "it")).select(
        "day", "name", "first_rank", "pos", F.col("it.ref_id").alias("ref_id"),
        F.array_join("it.tags", ",").alias("tags"))


@query("tag_index")
def q_tag_index(spark, sf_dir):
    """E5: tag -> story id entries of each day's digest."""
    _, _, cards = _digest_parts(spark, sf_dir)
    return DG.tag_index(cards, "day").select("day", "tag", "id", "rank")


@query("digest_stats")
def q_digest_stats(spark, sf_dir):
    """Items in / kept / stories / duplicates per day."""
    items, _, cards = _digest_parts(spark, sf_dir)
    return DG.stats(items, cards, "day")


@query("mock_digest")
def q_mock_digest(spark, sf_dir):
    """the nested digest document per day, summarised flat."""
    items, ranked, _ = _digest_parts(spark, sf_dir)
    doc = DG.digest_document(items, ranked, "day", "2024-02-01")
    d = F.col("digest")
    return doc.select("day", d["schema_version"].alias("schema_version"), d["generated_at"].alias("generated_at"),
                      d["stats"]["items_in"].alias("items_in"), d["stats"]["items_kept"].alias("items_kept"),
                      F.size(d["top_stories"]).alias("n_stories"), F.size(d["sections"]).alias("n_sections"),
                      F.array_join(F.transform(d["top_stories"], lambda s: s["id"]), ",").alias("story_ids"),
                      F.size(F.map_keys(d["tag_index"])).alias("n_tags"))


@query("digest_payload")
def q_digest_payload(spark, sf_dir):
    """model payload item (nulls omitted, content cut at 3000) for each day's top-k."""
    _, ranked, _ = _digest_parts(spark, sf_dir)
    return ranked.select("day", "rank", DG.payload_item(ranked).alias("payload"))


@query("digest_request")
def q_digest_request(spark, sf_dir):
    """the whole request payload of each day: items as one ordered JSON array and the counts line."""
    items, ranked, _ = _digest_parts(spark, sf_dir)
    return DG.payload_document(items, ranked, "day")


@query("items_fingerprint")
def q_items_fingerprint(spark, sf_dir):
    """Fingerprint of each day's top-k item set."""
    _, ranked, _ = _digest_parts(spark, sf_dir)
    return DG.fingerprint(ranked, "day")


@query("cache_lookup")
def q_cache_lookup(spark, sf_dir):
    """Each day's fingerprint looked up in a cache of digests built from the
    history articles alone (days whose top-k did not change hit)."""
    _, ranked, _ = _digest_parts(spark, sf_dir)
    lib = _library(spark, sf_dir)
    hist, _ = S.history_split(lib.withColumn("date", F.col("published_date")))
    h_items = _day_items(hist.drop("date"))
    cache = (DG.fingerprint(DG.top_k_per_group(h_items, "day", S.AS_OF, 30), "day")
             .select("fingerprint", F.lit("r1").alias("run"), F.col("day").cast("string").alias("doc")))
    return DG.cache_lookup(DG.fingerprint(ranked, "day"), cache).select("day", "fingerprint", "hit")


@query("digest_validate")
def q_digest_validate(spark, sf_dir):
    """each day's document as JSON text, parsed back and checked against the contract."""
    items, ranked, _ = _digest_parts(spark, sf_dir)
    doc = DG.digest_document(items, ranked, "day", "2024-02-01")
    v = DG.validate_reply(doc.select("day", DG.digest_json(doc).alias("reply")))
    return v.select("day", "valid", F.size("parsed.top_stories").alias("n_stories"))


@query("digest_written")
def q_digest_written(spark, sf_dir):
    """Each day's document written as a JSON file and read back."""
    import uuid

    from broadsheet.session import ensure_checkpoint_dir

    items, ranked, _ = _digest_parts(spark, sf_dir)
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/digests-{uuid.uuid4().hex}"
    DG.write_digest_json(DG.digest_document(items, ranked, "day", "2024-02-01"), "day", path)
    back = spark.read.schema(DIGEST).json(path)
    return back.select(F.col("day").cast("date").alias("day"), "schema_version", "generated_at", "stats.items_in",
                       F.size("top_stories").alias("n_stories"))


@query("cache_put")
def q_cache_put(spark, sf_dir):
    """The cache after two runs (history alone, then all articles): one row per fingerprint, the newest."""
    _, ranked, _ = _digest_parts(spark, sf_dir)
    hist, _ = S.history_split(_library(spark, sf_dir).withColumn("date", F.col("published_date")))
    old = DG.fingerprint(DG.top_k_per_group(_day_items(hist.drop("date")), "day", S.AS_OF, 30), "day")
    new = DG.fingerprint(ranked, "day")
    doc = F.concat(F.col("run"), F.lit(":"), F.col("day").cast("string"))
    made = lambda fps, run: fps.withColumn("run", F.lit(run)).select("fingerprint", "run", doc.alias("doc"))
    return DG.cache_put(made(old, "r1"), made(new, "r2"), "r2")


def _replies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(replies, mock documents) per day: replies of even days are whole, of odd days damaged in turn:
    no subtitle, a score of 6, two bullets, or no JSON."""
    items, ranked, _ = _digest_parts(spark, sf_dir)
    doc = DG.digest_document(items, ranked, "day", "2024-02-01")
    kind = F.pmod(F.dayofmonth("day"), F.lit(8))
    text = F.regexp_replace(DG.digest_json(doc), '"generated_at":"2024-02-01"', '"generated_at":"2024-02-02"')
    hurt = (F.when(kind == 1, F.regexp_replace(text, '"subtitle":"[^"]*",', ""))
            .when(kind == 3, F.regexp_replace(text, '"importance":[0-9]', '"importance":6'))
            .when(kind == 5, F.regexp_replace(text, r'"bullets":\[("(?:[^"\\\\]|\\\\.)*","(?:[^"\\\\]|\\\\.)*")[^\]]*\]', r'"bullets":[$1]'))
            .when(kind == 7, F.substring(text, 1, 40)).otherwise(text))
    return doc.select("day", hurt.alias("reply")), doc


@query("reply_fallback")
def q_reply_fallback(spark, sf_dir):
    """each day's document: its reply when valid, else the mock."""
    replies, doc = _replies(spark, sf_dir)
    out = DG.reply_documents(replies, doc, "day")
    return out.select("day", "origin", F.col("digest.generated_at").alias("generated_at"), F.size("digest.top_stories").alias("n_stories"))


@query("digest_integrity")
def q_digest_integrity(spark, sf_dir):
    """F8: integrity checks of each day's document, damaged by day of the month.

    Every document gets a tag index.  Of four days, the first has five search
    summaries, the second a story without URL, the third every section twice,
    the fourth two tag ids without a story.
    """
    items, ranked, _ = _digest_parts(spark, sf_dir)
    doc = DG.digest_document(items, ranked, "day", "2024-02-01")
    kinds = {f.name: f.dataType for f in doc.schema["digest"].dataType.fields}
    kind, d = F.dayofmonth("day") % 4, F.col("digest")
    ids = F.transform(d["top_stories"], lambda s: s["id"])
    index = F.when(kind == 3, F.create_map(F.lit("all"), ids, F.lit("gone"), F.array(F.lit("x"), F.lit("y")))).otherwise(F.create_map(F.lit("all"), ids))
    five = F.array_repeat(F.lit(None).cast(kinds["search_summaries"].elementType), 5)
    damaged = (d.withField("tag_index", index.cast(kinds["tag_index"]))
               .withField("search_summaries", F.when(kind == 0, five).otherwise(d["search_summaries"]))
               .withField("top_stories", F.transform(d["top_stories"], lambda s, i: F.when((kind == 1) & (i == 0), s.withField("url", F.lit(""))).otherwise(s)))
               .withField("sections", F.when(kind == 2, F.concat(d["sections"], d["sections"])).otherwise(d["sections"])))
    return DG.integrity(doc.withColumn("digest", damaged), "day")


@query("trending")
def q_trending(spark, sf_dir):
    """Tags carried by articles of at least 3 distinct sources inside the 7-day window."""
    a = R.rolling_window(S.articles(spark, sf_dir), S.AS_OF[:10], 7)
    m = a.select(F.explode("tags").alias("entity"), "source")
    return DG.trending(m)


@query("trending_daily")
def q_trending_daily(spark, sf_dir):
    """E7 with C8 for every day: tags carried by articles of at least 3 distinct sources in the 7 days ending on it."""
    a = S.articles(spark, sf_dir).withColumn("day", F.to_date(D.parse_loose_date(F.col("date"))))
    m = a.select(F.explode("tags").alias("entity"), "source", "day")
    return DG.trending_daily(m)


@query("window7")
def q_window7(spark, sf_dir):
    """Articles dated inside the 7 days ending on the as-of day."""
    return R.rolling_window(S.articles(spark, sf_dir), S.AS_OF[:10], 7).select("ord", "date")


@query("story_search")
def q_story_search(spark, sf_dir):
    """H1: search terms over every day's story cards."""
    _, _, cards = _digest_parts(spark, sf_dir)
    return SE.story_search(cards, SEARCH_TERMS, "day")


def _hints(cards):
    """One search hint per tag of each digest: hint = tag, refs = its stories in rank order."""
    idx = DG.tag_index(cards, "day")
    return (idx.groupBy("day", "tag")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("r"))
            .select("day", F.col("tag").alias("query_hint"), F.array("tag").alias("matching_tags"),
                    F.transform("r", lambda x: x["id"]).alias("top_refs")))


@query("hint_search")
def q_hint_search(spark, sf_dir):
    """H2: search terms over the digests' search hints, refs exploded."""
    _, _, cards = _digest_parts(spark, sf_dir)
    return SE.hint_search(_hints(cards), SEARCH_TERMS, "day")


@query("tag_filter")
def q_tag_filter(spark, sf_dir):
    """H3: stories and section items allowed by each requested tag (all / known / unknown)."""
    _, _, cards = _digest_parts(spark, sf_dir)
    items = DG.sections(cards, "day").select("day", "name", F.explode("items").alias("it")).select("day", "name", F.col("it.ref_id").alias("id"))
    return SE.tag_filter(cards, DG.tag_index(cards, "day"), FILTER_TAGS, "day", items)


@query("facets")
def q_facets(spark, sf_dir):
    """H4: sorted tag list of each digest."""
    _, _, cards = _digest_parts(spark, sf_dir)
    return SE.tag_facets(DG.tag_index(cards, "day"), "day")


@query("section_facets")
def q_section_facets(spark, sf_dir):
    """H4: items per section of each digest."""
    _, _, cards = _digest_parts(spark, sf_dir)
    items = DG.sections(cards, "day").select("day", "name", F.explode("items").alias("it"))
    return SE.section_facets(items, "day")


@query("report_rows")
def q_report_rows(spark, sf_dir):
    """H5: numbered report rows of each digest."""
    _, _, cards = _digest_parts(spark, sf_dir)
    return SE.report_rows(cards, "day")


# ------------------------------------------------- sources, feeds, ingest

from broadsheet.functions.urls import url_host  # noqa: E402
from broadsheet.plans import ingest as IG  # noqa: E402
from broadsheet.sources import feeds as FD  # noqa: E402

FEED_PAGE = 20        # entries per generated feed document
ITEMS_PER_FILE = 100  # items per generated items-array document
RUN_TS = "2024-02-01 08:00:00"


def _xml_text(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _raw_feeds(spark, sf_dir) -> DataFrame:
    """Raw-feed table built from the pages: per host, feed documents of up to 20 entries.

    By page number they are plain RSS, RSS behind a byte order mark, declarations
    and a document type, RSS with bare ampersands and HTML references, prefixed
    Atom, RSS of CDATA titles with links only as permanent guids, and RSS that
    holds a broken entry, an unclosed one and no end.
    """
    p = H.with_page_meta(S.pages(spark, sf_dir), "html")
    p = p.select("ord", "url", url_host("url").alias("host"), F.floor(F.col("ord") / FEED_PAGE).alias("page"),
                 F.coalesce("title", F.lit("")).alias("t"))
    p = p.withColumn("feed_url", F.concat(F.lit("https://"), F.col("host"), F.lit("/feed.xml?page="), F.col("page").cast("string")))
    kind, t, url = F.pmod("page", F.lit(6)), F.col("t"), _xml_text(F.col("url"))

    def entry(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    item = (F.when(kind == 2, entry("<item><title>", _xml_text(t), " R&D&nbsp;x</title><link>", url, "</link></item>"))
            .when(kind == 3, entry("<a:entry><a:source><a:title>no</a:title></a:source><a:title>", _xml_text(t), "</a:title><a:link rel='self' href='https://no'/><a:link href=\"",
                                   F.replace(url, F.lit('"'), F.lit("&quot;")), "\"/></a:entry>"))
            .when(kind == 4, entry("<item><title><![CDATA[", t, "]]></title><guid>", url, "</guid></item>"))
            .otherwise(entry("<item><title>", _xml_text(t), "</title><link>", url, "</link></item>")))
    rss = "<rss version=\"2.0\"><channel><title>feed</title>"
    head = (F.when(kind == 1, "\ufeff<?xml version='1.0'?>\n<?xml-stylesheet href='x.xsl'?><!DOCTYPE rss [<!ENTITY x 'y'>]><!-- <item> -->" + rss)
            .when(kind == 3, "<a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:title>feed</a:title>")
            .when(kind == 5, rss + "<item><title>x<y</title><link>https://no</link></item><item><title>z</title>").otherwise(rss))
    tail = F.when(kind == 3, "</a:feed>").when(kind == 5, "<item><title>cut").otherwise("</channel></rss>")
    return (p.withColumn("item", item).withColumn("head", head).withColumn("tail", tail).groupBy("feed_url")
            .agg(F.min("ord").alias("first_ord"), F.first("head").alias("head"), F.first("tail").alias("tail"),
                 F.sort_array(F.collect_list(F.struct("ord", F.col("item").alias("x")))).alias("xs"))
            .select("feed_url", "first_ord", F.concat("head", F.array_join(F.transform("xs", lambda s: s["x"]), ""), "tail").alias("xml")))


def _source_file(spark, sf_dir) -> DataFrame:
    """Lines of a sources file: a comment, a blank line, the feeds, then every page URL."""
    feeds = _raw_feeds(spark, sf_dir).select(F.col("first_ord").alias("pos"), F.col("feed_url").alias("value"))
    pages = S.pages(spark, sf_dir).select((F.col("ord") + F.lit(1_000_000_000)).alias("pos"), F.col("url").alias("value"))
    head = spark.createDataFrame([(-2, "# feeds first, then direct article URLs"), (-1, "   ")], "pos long, value string")
    return head.unionByName(feeds).unionByName(pages)


def _expanded(spark, sf_dir, limit=None) -> DataFrame:
    return FD.expand_sources(FD.source_lines(_source_file(spark, sf_dir)), _raw_feeds(spark, sf_dir), limit)


@query("src_list")
def q_src_list(spark, sf_dir):
    """A1: the sources file's kept lines (trimmed, no blanks, no comments)."""
    return FD.source_lines(_source_file(spark, sf_dir))


@query("feed_items")
def q_feed_items(spark, sf_dir):
    """A3: entries of every generated feed, each parsed with from_xml."""
    return FD.feed_items(FD.parse_feeds(_raw_feeds(spark, sf_dir)))


@query("feed_limit")
def q_feed_limit(spark, sf_dir):
    """C4: first kept entry of every feed (limit 1)."""
    return FD.feed_items(FD.parse_feeds(_raw_feeds(spark, sf_dir)), limit=1)


@query("expand_sources")
def q_expand_sources(spark, sf_dir):
    """A4: every source line replaced by the article URLs it stands for."""
    return _expanded(spark, sf_dir).select("source_ord", "pos", "source_url", "url", "n_entries")


@query("items_scan")
def q_items_scan(spark, sf_dir):
    """A5: items JSON documents (per source, files of up to 100 items) parsed with the item schema."""
    a = S.articles(spark, sf_dir).withColumn("part", F.floor(F.col("ord") / ITEMS_PER_FILE))
    items = a.select("source", "part", "ord", F.to_json(F.struct("title", "url", "source", "date")).alias("one"))
    docs = (items.groupBy("source", "part")
            .agg(F.sort_array(F.collect_list(F.struct("ord", "one"))).alias("xs"))
            .select("source", "part", F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["one"]), ","),
                                               F.lit("]")).alias("doc")))
    p = FD.parse_items_json(docs)
    return p.select("source", "part", "valid", "pos", F.col("item.title").alias("title"),
                    F.col("item.url").alias("url"), F.col("item.date").alias("date"))


def _page_log(spark, sf_dir) -> DataFrame:
    """Seen log of an earlier run that stored every seventh page, as it reads today; written once, for its readers."""
    old = P.extract_pages(S.pages(spark, sf_dir).filter(F.pmod("ord", F.lit(7)) == 0))
    old = U.with_url_hash(old, "url", "url_hash").withColumn("content_hash", TX.content_hash("text"))
    ts = F.lit("2024-01-15 08:00:00").cast("timestamp_ntz")
    return cut_lineage(seen_records(old.withColumn("batch_id", F.lit(0)).withColumn("fetched_at", ts).withColumn("source_type", _stored_type())
                                    .withColumn("stored_path", X.storage_path(F.col("title"), ts))))


def _ingest(spark, sf_dir) -> IG.IngestResult:
    """Batch ingest against the earlier run's log; every eleventh direct line is forced."""
    rows = _expanded(spark, sf_dir).withColumn(
        "forced", (F.col("source_ord") >= 1_000_000_000) & (F.pmod("source_ord", F.lit(11)) == 0))
    return IG.ingest_batch(rows, S.pages(spark, sf_dir), None, RUN_TS, seen_log=_page_log(spark, sf_dir), force_col="forced")


def _flat_order(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("ord.source_ord", "ord.pos", *[c for c in outcomes.columns if c != "ord"])


@query("ingest_batch")
def q_ingest_batch(spark, sf_dir):
    """Batch ingest of the sources file (feeds then pages) with history and forced lines: one outcome per URL."""
    return _flat_order(_ingest(spark, sf_dir).outcomes)


@query("run_summary")
def q_run_summary(spark, sf_dir):
    """Ingested / skipped / errors of the batch ingest."""
    return IG.run_summary(_ingest(spark, sf_dir).outcomes)


@query("ingest_dry_run")
def q_ingest_dry_run(spark, sf_dir):
    """Dry-run ingest of every page against the earlier run's log; every eleventh is forced."""
    latest = DD.seen_latest(_page_log(spark, sf_dir))
    pages = S.pages(spark, sf_dir).withColumn("force", F.pmod("ord", F.lit(11)) == 0)
    return IG.dry_run(pages, latest, force_col="force")


@query("incremental_ingest")
def q_incremental_ingest(spark, sf_dir):
    """The sources file arrives as two drops (feeds, then page URLs) into a
    file stream; each micro-batch runs the batch ingest against the seen log
    of the batches before it.  Outcomes equal the one-shot batch ingest."""
    import uuid

    from broadsheet.session import ensure_checkpoint_dir
    from broadsheet.streaming import incremental as INC

    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/incremental-{uuid.uuid4().hex}"
    lines = _source_file(spark, sf_dir)
    # part files hold ranges of positions, so the order of files and lines is that of the positions
    drops = [lines.filter(part).repartitionByRange("pos").sortWithinPartitions("pos")
             for part in (F.col("pos") < 1_000_000_000, F.col("pos") >= 1_000_000_000)]
    drops[0].write.parquet(f"{base}/sources/drop=0")
    q = INC.start_incremental_ingest(spark, f"{base}/sources/*", lambda: _raw_feeds(spark, sf_dir), lambda: S.pages(spark, sf_dir),
                                     f"{base}/out", f"{base}/checkpoint", RUN_TS, interval="1 second", buckets=8)
    try:
        q.processAllAvailable()
        drops[1].write.parquet(f"{base}/sources/drop=1")
        q.processAllAvailable()
    finally:
        q.stop()
    out = INC.read_outcomes(spark, f"{base}/out").drop("batch_id")
    return out.select(F.col("ord.source_ord.pos").alias("source_ord"), "ord.pos", *[c for c in out.columns if c != "ord"])

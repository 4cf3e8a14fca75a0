"""Digest document: per-group top-k, cards, sections, tag index, stats, payload,
fingerprint, cache, reply validation and integrity checks (C4-C6, E3-E7, F4-F8, G3, G4).

Every function takes a ``group`` column (e.g. the fetch day): one digest per
group value, all groups in one distributed pass.  Per-group top-k uses a
``row_number() <= k`` filter, which Spark plans as a window group limit (each
map task forwards at most ``k`` rows per group), so a group holding a third
of all items never reaches one task whole.  Anything collected into a list
(cards, sections, fingerprint keys) is bounded by ``k``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.text import story_slug
from broadsheet.operators.rank import with_scores
from broadsheet.schemas import DIGEST

# Mock digest constants.
MOCK_STORIES = 12
SECTION = "Other"

# The counts line behind a request's items, around the two counts.
PAYLOAD_COUNTS = ("共 ", " 条原始输入，上面是 pre-rank 后的 Top ", " 条。")
UNKNOWN = "unknown"
UNTAGGED = ["untagged"]
SOURCE_LABEL = "来源: "
DATE_LABEL = "日期: "
WHY = "需要 LLM 生成详细分析"
ACTION = "配置 LLM 以获取完整摘要"
NOTES = "Mock 生成，仅结构占位"
READ_CHARS = 1500
PAYLOAD_CONTENT_MAX = 3000
SCHEMA_VERSION = "v1"


def top_k_per_group(items: DataFrame, group: str, as_of: str, k: int = 30,
                    snippet_col: str | None = None) -> DataFrame:
    """C5 per group: score, then keep the first ``k`` by score desc, ord asc (``rank`` 1-based)."""
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col("ord").asc())
    return (with_scores(items, as_of, snippet_col)
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))


def story_cards(ranked: DataFrame, group: str, n: int = MOCK_STORIES) -> DataFrame:
    """F4 (C6): cards for the first ``n`` ranked items of each group."""
    r = ranked.filter(F.col("rank") <= n)
    snippet = F.col("snippet") if "snippet" in r.columns else F.lit(None).cast("string")
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.nullif(snippet, F.lit("")), F.lit(""))
    sid = F.coalesce(F.nullif(story_slug(F.col("title")), F.lit("")),
                     F.concat(F.lit("item-"), (F.col("rank") - 1).cast("string")))
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    return r.select(
        group, "rank", sid.alias("id"), "title", F.substring("title", 1, 40).alias("subtitle"), "url",
        _or_unknown(F.col("source")).alias("source"), _or_unknown(F.col("date")).alias("date"),
        F.lit(SECTION).alias("section"), F.substring("title", 1, 26).alias("one_liner"),
        F.array(F.substring(F.coalesce(F.nullif(snippet, F.lit("")), F.col("title")), 1, 22),
                F.substring(F.concat(F.lit(SOURCE_LABEL), _or_unknown(F.col("source"))), 1, 22),
                F.substring(F.concat(F.lit(DATE_LABEL), _or_unknown(F.col("date"))), 1, 22)).alias("bullets"),
        F.lit(WHY).alias("why_it_matters"), F.array(F.lit(ACTION)).alias("action_items"),
        F.greatest(F.lit(1), F.floor(F.length(body) / READ_CHARS).cast("int")).alias("read_time_min"),
        F.struct(F.lit(3).alias("importance"), F.lit(3).alias("credibility"), F.lit(3).alias("freshness")).alias("scores"),
        F.when(F.size(tags) > 0, tags).otherwise(F.array(*[F.lit(t) for t in UNTAGGED])).alias("tags"),
        tags.alias("item_tags"),
        F.lit(NOTES).alias("notes"))


def sections(cards: DataFrame, group: str) -> DataFrame:
    """Sections in first-appearance order, items in rank order (bounded by the card count)."""
    item = F.struct("rank", F.col("id").alias("ref_id"), "title", "url", "source", "date", "one_liner",
                    "scores", F.col("item_tags").alias("tags"))
    return (cards.groupBy(group, "section")
            .agg(F.min("rank").alias("first_rank"), F.sort_array(F.collect_list(item)).alias("items"))
            .select(group, F.col("section").alias("name"), "first_rank",
                    F.transform("items", lambda x: x.dropFields("rank")).alias("items")))


def tag_index(cards: DataFrame, group: str) -> DataFrame:
    """E5 (flat): tag -> story id rows, ids in rank order, ids only of existing stories."""
    return (cards.select(group, "rank", "id", F.explode(F.array_distinct("item_tags")).alias("tag")))


def stats(items: DataFrame, cards: DataFrame, group: str, duplicates: DataFrame | None = None) -> DataFrame:
    """items_in (before top-k), items_kept, top_stories_count, duplicates_count per group."""
    s = items.groupBy(group).agg(F.count(F.lit(1)).cast("int").alias("items_in"))
    c = cards.groupBy(group).agg(F.count(F.lit(1)).cast("int").alias("items_kept"))
    out = s.join(c, group, "left").select(group, "items_in", F.coalesce("items_kept", F.lit(0)).alias("items_kept"))
    out = out.withColumn("top_stories_count", F.col("items_kept"))
    if duplicates is None:
        return out.withColumn("duplicates_count", F.lit(0))
    d = duplicates.groupBy(group).agg(F.count(F.lit(1)).cast("int").alias("duplicates_count"))
    return out.join(d, group, "left").withColumn("duplicates_count", F.coalesce("duplicates_count", F.lit(0)))


def digest_document(items: DataFrame, ranked: DataFrame, group: str, generated_at: str) -> DataFrame:
    """one nested digest row per group (the mock document: empty tag index,
    no search summaries, no duplicates)."""
    cards = story_cards(ranked, group)
    story = F.struct(*[F.col(f) for f in ["id", "title", "subtitle", "url", "source", "date", "section",
                                          "one_liner", "bullets", "why_it_matters", "action_items",
                                          "read_time_min", "scores", "tags", "notes"]])
    st = cards.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", story.alias("s")))).alias("st"))
    sec = (sections(cards, group).groupBy(group)
           .agg(F.sort_array(F.collect_list(F.struct("first_rank", F.struct("name", "items").alias("x")))).alias("sec")))
    return (stats(items, cards, group)
            .join(st, group, "left").join(sec, group, "left")
            .select(group, F.struct(
                F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(generated_at).alias("generated_at"),
                F.struct("items_in", "items_kept", "top_stories_count", "duplicates_count").alias("stats"),
                F.transform(F.coalesce("st", F.array()), lambda x: x["s"]).alias("top_stories"),
                F.transform(F.coalesce("sec", F.array()), lambda x: x["x"]).alias("sections"),
                F.create_map().cast("map<string,array<string>>").alias("tag_index"),
                F.array().cast(DIGEST["search_summaries"].dataType).alias("search_summaries"),
                F.array().cast(DIGEST["duplicates"].dataType).alias("duplicates"),
            ).alias("digest")))


def digest_json(doc: DataFrame) -> Column:
    """The document as JSON text (non-ASCII kept)."""
    return F.to_json(doc["digest"])


def write_digest_json(doc: DataFrame, group: str, path: str) -> None:
    """G3 sink: one JSON document per group folder."""
    doc.select(group, F.col("digest.*")).write.mode("overwrite").partitionBy(group).json(path)


# ------------------------------------------------------------------ F6 / E3 / G4

def payload_item(df: DataFrame) -> Column:
    """one item of the model payload; NULL fields are left out, content
    over 3000 chars is cut and marked with an ellipsis."""
    c = F.col("content")
    content = F.when(F.length(c) > PAYLOAD_CONTENT_MAX,
                     F.concat(F.substring(c, 1, PAYLOAD_CONTENT_MAX), F.lit("…"))).otherwise(c)
    cols = [F.col("title"), F.col("url"), F.col("source"), F.col("date"),
            (F.col("snippet") if "snippet" in df.columns else F.lit(None).cast("string")).alias("snippet"),
            content.alias("content"),
            (F.col("author") if "author" in df.columns else F.lit(None).cast("string")).alias("author"),
            F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags")]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "true"})


def payload_document(items: DataFrame, ranked: DataFrame, group: str) -> DataFrame:
    """the user part of a digest request per group: the top items as one JSON
    array in rank order, then a line with the counts of all and of sent items."""
    total = items.groupBy(group).agg(F.count(F.lit(1)).alias("_all"))
    each = ranked.select(group, "rank", payload_item(ranked).alias("p"))
    sent = each.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", "p"))).alias("_p"))  # at most the top k
    body = F.concat(F.lit("["), F.array_join(F.transform("_p", lambda x: x["p"]), ", "), F.lit("]"))
    a, b, c = PAYLOAD_COUNTS
    return sent.join(total, group).select(group, F.concat(
        F.lit("items = "), body, F.lit("\n\n" + a), F.col("_all").cast("string"), F.lit(b),
        F.size("_p").cast("string"), F.lit(c)).alias("payload"))


def json_string_escape(x: Column) -> Column:
    """JSON string body escaping: backslash, quote and control characters."""
    c = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        c = F.replace(c, F.lit(chr(code)), F.lit(named.get(code, "\\u%04x" % code)))
    return c


def fingerprint(ranked: DataFrame, group: str) -> DataFrame:
    """Per group, sha-256 of the JSON array of sorted ``title|url`` keys, first 16 hex."""
    keys = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.concat_ws("|", "title", "url"))).alias("keys"))
    body = F.array_join(F.transform("keys", json_string_escape), '", "')
    blob = F.when(F.size("keys") == 0, F.lit("[]")).otherwise(F.concat(F.lit('["'), body, F.lit('"]')))
    return keys.select(group, F.substring(F.sha2(blob, 256), 1, 16).alias("fingerprint"))


def cache_latest(cache: DataFrame) -> DataFrame:
    """One row per fingerprint of a cache table ``(fingerprint, run, doc)``: the last run's."""
    return cache.groupBy("fingerprint").agg(F.max_by("doc", F.struct("run", "doc")).alias("doc"), F.max("run").alias("run"))


def cache_lookup(fps: DataFrame, cache: DataFrame) -> DataFrame:
    """G4 get: run fingerprints with the cached document, one row each (``hit`` false: none)."""
    found = cache_latest(cache).select("fingerprint", "doc")
    return fps.join(found, "fingerprint", "left").withColumn("hit", F.col("doc").isNotNull())


def cache_put(cache: DataFrame, made: DataFrame, run: str) -> DataFrame:
    """G4 put: the cache with this run's documents ``(fingerprint, doc)``; each fingerprint has one row, the newest."""
    new = made.select("fingerprint", F.lit(run).alias("run"), "doc")
    return cache_latest(cache.select("fingerprint", "run", "doc").unionByName(new)).select("fingerprint", "run", "doc")


# ---------------------------------------------------------------- F7 / F8

def _all_set(x: Column, fields: list[str]) -> Column:
    ok = F.lit(True)
    for f in fields:
        ok = ok & x[f].isNotNull()
    return ok


def _each(xs: Column, test) -> Column:
    """Every element passes; a list is needed, an empty one is fine."""
    return F.coalesce(F.forall(xs, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def validate_reply(replies: DataFrame, reply_col: str = "reply") -> DataFrame:
    """parse a model reply against the document schema and the contract.

    All fields are required but those with a default (schema version, notes,
    a section item's tags, tag index, search summaries, duplicates); stories
    have 3 to 5 bullets and scores are 1 to 5.  Adds ``parsed`` and ``valid``;
    :func:`reply_documents` replaces invalid replies.
    """
    p = replies.withColumn("parsed", F.from_json(F.col(reply_col), DIGEST, {"mode": "PERMISSIVE"}))
    d = F.col("parsed")
    text = lambda xs: _each(xs, lambda x: x.isNotNull())
    optional = lambda xs, test: xs.isNull() | _each(xs, test)

    def scores(s):
        return F.coalesce(F.forall(F.array(s["importance"], s["credibility"], s["freshness"]),
                                   lambda v: F.coalesce(v.between(1, 5), F.lit(False))), F.lit(False))

    def story(s):
        return (_all_set(s, ["id", "title", "subtitle", "url", "source", "date", "section", "one_liner", "why_it_matters", "read_time_min"])
                & F.size(s["bullets"]).between(3, 5) & text(s["bullets"]) & text(s["action_items"]) & text(s["tags"]) & scores(s["scores"]))

    def item(i):
        return (_all_set(i, ["ref_id", "title", "url", "source", "date", "one_liner"]) & scores(i["scores"])
                & optional(i["tags"], lambda x: x.isNotNull()))

    def section(sec):
        return sec["name"].isNotNull() & _each(sec["items"], item)

    def summary(x):
        return _all_set(x, ["query_hint", "one_sentence_map"]) & text(x["matching_tags"]) & text(x["top_refs"])

    valid = (d["generated_at"].isNotNull() & _all_set(d["stats"], ["items_in", "items_kept", "top_stories_count", "duplicates_count"])
             & _each(d["top_stories"], story) & _each(d["sections"], section)
             & (d["tag_index"].isNull() | _each(F.map_values(d["tag_index"]), text)) & optional(d["search_summaries"], summary)
             & optional(d["duplicates"], lambda x: _all_set(x, ["title", "url", "merged_into", "reason"])))
    return p.withColumn("valid", F.coalesce(d.isNotNull() & valid, F.lit(False)))


def reply_documents(replies: DataFrame, mock: DataFrame, group: str, reply_col: str = "reply") -> DataFrame:
    """one document per group of ``mock`` (F5): its reply when valid, with defaults filled in, else the mock.

    ``origin`` tells which.  Of several replies of a group the smallest valid text is taken.
    """
    v = validate_reply(replies, reply_col).filter("valid").groupBy(group).agg(F.min_by("parsed", F.col(reply_col)).alias("parsed"))
    d = F.col("parsed")
    blank = lambda name: F.coalesce(d[name], F.array().cast(DIGEST[name].dataType))
    stories = F.transform(d["top_stories"], lambda s: s.withField("notes", F.coalesce(s["notes"], F.lit(""))))
    sections_ = F.transform(d["sections"], lambda x: x.withField("items", F.transform(x["items"], lambda i: i.withField(
        "tags", F.coalesce(i["tags"], F.array().cast("array<string>"))))))
    full = F.struct(F.coalesce(d["schema_version"], F.lit(SCHEMA_VERSION)).alias("schema_version"), d["generated_at"].alias("generated_at"),
                    d["stats"].alias("stats"), stories.alias("top_stories"), sections_.alias("sections"),
                    F.coalesce(d["tag_index"], F.create_map().cast("map<string,array<string>>")).alias("tag_index"),
                    blank("search_summaries").alias("search_summaries"), blank("duplicates").alias("duplicates"))
    joined = mock.select(group, "digest").join(v, group, "left")
    return joined.select(group, F.when(d.isNotNull(), "reply").otherwise("mock").alias("origin"),
                         F.when(d.isNotNull(), full).otherwise(F.col("digest").cast(DIGEST)).alias("digest"))


def integrity(doc: DataFrame, group: str) -> DataFrame:
    """F8: per document, stories not in exactly one section, tag-index ids
    without a story, whether there are 4-6 search summaries, stories
    missing URL or date."""
    stories = doc.select(group, F.explode_outer("digest.top_stories").alias("s")).select(group, F.col("s.id").alias("id"),
                                                                                          F.col("s.url").alias("url"),
                                                                                          F.col("s.date").alias("date"))
    refs = (doc.select(group, F.explode("digest.sections").alias("sec"))
            .select(group, F.explode("sec.items").alias("it")).select(group, F.col("it.ref_id").alias("id")))
    per_story = (stories.filter(F.col("id").isNotNull()).join(refs.groupBy(group, "id").count(), [group, "id"], "left")
                 .groupBy(group).agg(F.count_if(F.coalesce(F.col("count"), F.lit(0)) != 1).alias("not_one_section"),
                                     F.count_if(F.coalesce(F.col("url"), F.lit("")).isin("", UNKNOWN)
                                                | F.coalesce(F.col("date"), F.lit("")).isin("", UNKNOWN)).alias("missing_url_or_date")))
    tag_ids = (doc.select(group, F.explode("digest.tag_index").alias("tag", "ids"))
               .select(group, F.explode("ids").alias("id")))
    dangling = (tag_ids.join(stories.select(group, "id"), [group, "id"], "left_anti")
                .groupBy(group).agg(F.count(F.lit(1)).alias("dangling_tag_ids")))
    hints = doc.select(group, F.size("digest.search_summaries").between(4, 6).alias("search_summaries_ok"))
    return (hints.join(per_story, group, "left").join(dangling, group, "left")
            .select(group, "search_summaries_ok",
                    F.coalesce("not_one_section", F.lit(0)).alias("not_one_section"),
                    F.coalesce("dangling_tag_ids", F.lit(0)).alias("dangling_tag_ids"),
                    F.coalesce("missing_url_or_date", F.lit(0)).alias("missing_url_or_date")))


def trending(mentions: DataFrame, entity: str = "entity", source: str = "source", min_sources: int = 3) -> DataFrame:
    """Entities mentioned by at least ``min_sources`` distinct sources.

    Distinct (entity, source) pairs first (a partial aggregation), then a count
    per entity, so a hot entity is never gathered as raw mentions in one task.
    """
    pairs = mentions.select(entity, source).distinct()
    return (pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("n_sources"))
            .filter(F.col("n_sources") >= min_sources))


def trending_daily(mentions: DataFrame, entity: str = "entity", source: str = "source", day: str = "day",
                   days: int = 7, min_sources: int = 3) -> DataFrame:
    """E7 over C8 for every day: ``(day, entity, n_sources)`` of the ``days`` days that end on it.

    One pass, without repeating a mention for each window it is in.  A day on
    which a source mentions an entity covers the windows ending on that day and
    up to ``days - 1`` days later, cut at the source's next mention; so a
    window counts a source once.  The count of an entity changes where such a
    stretch starts or ends, and a running sum over these changes gives it for
    all days, those after the last mention included.

    Mentions collapse map-side to one row per (entity, source, day); no window
    holds more rows than the calendar has days, however common an entity or a
    source.  Undated mentions are in no window; a null source is one source.
    """
    d = mentions.select(F.col(entity).alias("entity"), F.col(source).alias("source"), F.col(day).cast("date").alias("day"))
    seen = d.filter(F.col("day").isNotNull()).distinct()
    after = F.lead("day").over(Window.partitionBy("entity", "source").orderBy("day"))
    stretch = seen.select("entity", "day", F.least(F.date_add("day", days), after).alias("end"))
    edges = stretch.select("entity", F.inline(F.array(F.struct(F.col("day").alias("day"), F.lit(1).alias("by")),
                                                      F.struct(F.col("end").alias("day"), F.lit(-1).alias("by")))))
    changes = edges.groupBy("entity", "day").agg(F.sum("by").alias("by"))
    of = Window.partitionBy("entity").orderBy("day")
    level = changes.select("entity", "day", F.sum("by").over(of).alias("n_sources"), F.lead("day").over(of).alias("next"))
    return (level.filter(F.col("n_sources") >= min_sources)
            .select(F.explode(F.sequence("day", F.date_sub("next", 1))).alias("day"), "entity", "n_sources"))

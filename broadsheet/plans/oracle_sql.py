"""DuckDB oracle SQL per query key (same column names as ``queries.py``)."""

from __future__ import annotations

from broadsheet.plans import sqlfrag as Q

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _sel(items: list[str]) -> str:
    return ",\n  ".join(items)


TEXTS = """texts AS (
  SELECT 'documents' AS tbl, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'conversations', conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), text FROM benchmark)"""

URLS = """urls AS (
  SELECT 'art' AS tbl, ord, url FROM art
  UNION ALL SELECT 'pg', ord, url FROM pg)"""

SCORED = f"""scored AS (
  SELECT *,
  {_sel(Q.date_steps('date', 'dt'))},
  {Q.source_weight('source', 'url')} AS source_weight,
  {Q.freshness('dt')} AS freshness,
  {Q.length_score('content')} AS length_score,
  {Q.score('source_weight', 'freshness', 'length_score')} AS score
  FROM art)"""

# ------------------------------------------------------------------------- C

oracle("pre_rank", _with(Q.ART, SCORED) + """
SELECT CAST(row_number() OVER (ORDER BY score DESC, ord ASC) AS INTEGER) AS rank,
       ord, title, url, source, date, source_weight, freshness, length_score, score
FROM scored ORDER BY score DESC, ord ASC LIMIT 30""")

oracle("source_weight", _with(Q.ART) + f"""
SELECT ord, {Q.source_weight('source', 'url')} AS source_weight FROM art""")

oracle("freshness", _with(Q.ART) + f"""
SELECT ord, date, {Q.freshness('dt')} AS freshness FROM (
  SELECT ord, date, {_sel(Q.date_steps('date', 'dt'))} FROM art)""")

oracle("length_score", _with(Q.ART) + f"""
SELECT ord, {Q.length_score('content')} AS length_score FROM art""")

# -------------------------------------------------------------------- B4/B5/D

oracle("ws_norm", _with(TEXTS) + f"SELECT tbl, id, {Q.norm_ws('text')} AS norm FROM texts")
oracle("word_count", _with(TEXTS) + f"SELECT tbl, id, {Q.word_count('text')} AS word_count FROM texts")
oracle("content_hash", _with(TEXTS) + f"SELECT tbl, id, {Q.content_hash('text')} AS content_hash FROM texts")

oracle("url_norm", _with(Q.ART, Q.PG, URLS) + f"""
SELECT tbl, ord, url, u_norm AS url_norm FROM (SELECT tbl, ord, url, {_sel(Q.url_steps('url', 'u'))} FROM urls)""")

oracle("url_hash", _with(Q.ART, Q.PG, URLS) + f"""
SELECT tbl, ord, sha256(u_norm) AS url_hash FROM (SELECT tbl, ord, url, {_sel(Q.url_steps('url', 'u'))} FROM urls)""")

oracle("feed_url_class", _with(Q.ART, Q.PG, URLS) + f"""
SELECT tbl, ord, regexp_matches(lower(u_path), '/feed|/rss|/atom|\\.rss|\\.atom|\\.xml') AS is_feed
FROM (SELECT tbl, ord, url, {_sel(Q.url_steps('url', 'u'))} FROM urls)""")

# ------------------------------------------------------------- A6 / D5-D11

KEYED = Q.keyed_cte("art", "keyed")
HIST_PARTS = f"""hist AS (SELECT * FROM keyed WHERE {Q.HIST}),
batch AS (SELECT * FROM keyed WHERE NOT {Q.HIST}),
{Q.seen_recs_cte('hist', 'hrecs')},
{Q.latest_cte('hrecs', 'latest')}"""

oracle("seen_latest", "WITH RECURSIVE " + ",\n".join([Q.ART, KEYED, Q.seen_recs_cte("keyed", "recs"),
                                                        Q.latest_cte("recs", "latest")]) + """
SELECT url_hash, first_pos, url, content_hash, title, fetched_at, stored_path, source FROM latest""")

oracle("seen_content", _with(Q.ART, KEYED, HIST_PARTS) + "SELECT DISTINCT content_hash FROM latest")

oracle("dup_lookup", _with(Q.ART, KEYED, HIST_PARTS) + """,
byc AS (SELECT content_hash, arg_min(title, first_pos) AS content_title FROM latest GROUP BY content_hash)
SELECT b.ord,
  (l.title IS NOT NULL OR (coalesce(b.content, '') <> '' AND c.content_title IS NOT NULL)) AS is_dup,
  CASE WHEN l.title IS NOT NULL THEN 'URL already seen: ' || l.title
       WHEN coalesce(b.content, '') <> '' AND c.content_title IS NOT NULL THEN 'Content matches existing: ' || c.content_title
  END AS reason
FROM batch b LEFT JOIN latest l ON l.url_hash = b.url_hash
LEFT JOIN byc c ON c.content_hash = b.content_hash""".replace("\n,\nbyc", ",\nbyc"))

oracle("anti_seen", _with(Q.ART, KEYED, HIST_PARTS) + """
SELECT ord FROM batch b
WHERE b.url_hash NOT IN (SELECT url_hash FROM latest)
  AND (coalesce(b.content, '') = '' OR b.content_hash NOT IN (SELECT content_hash FROM latest))""")

oracle("greedy_dedup", "WITH RECURSIVE " + ",\n".join([
    Q.ART, KEYED,
    "keys AS (SELECT ord, url_hash AS u, CASE WHEN coalesce(content, '') <> '' THEN content_hash END AS cc, "
    "content_hash AS rc, false AS forced FROM keyed)",
    Q.walk_ctes("keys")]) + "\nSELECT ord, keep FROM walk WHERE i > 0")

oracle("force_ingest", "WITH RECURSIVE " + ",\n".join([
    Q.ART, KEYED, HIST_PARTS,
    "b AS (SELECT b.*, coalesce(l.content_hash <> b.content_hash, false) AS forced "
    "FROM batch b LEFT JOIN latest l ON l.url_hash = b.url_hash)",
    "keys AS (SELECT ord, url_hash AS u, CASE WHEN coalesce(content, '') <> '' THEN content_hash END AS cc, "
    "content_hash AS rc, forced FROM b)",
    Q.walk_ctes("keys", "(SELECT list(url_hash ORDER BY url_hash) FROM latest)",
                "(SELECT list(content_hash ORDER BY url_hash) FROM latest)")]) + """
SELECT b.ord, b.forced, w.keep FROM b JOIN walk w ON w.ord = b.ord""")

oracle("event_merge", _with(Q.ART, KEYED) + f""",
a AS (SELECT *, {Q.source_weight('source', 'url')} AS sw, length(content) AS n_chars,
      {Q.story_id('title', 'ord')} AS story_id FROM keyed),
r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY sw DESC, n_chars DESC, ord ASC) AS rn,
      count(*) OVER (PARTITION BY content_hash) AS n FROM a),
w AS (SELECT content_hash, ord AS winner_ord, story_id AS merged_into FROM r WHERE rn = 1 AND n > 1)
SELECT r.ord, r.title, r.url, w.merged_into, w.winner_ord, 'same content as the kept story' AS reason
FROM r JOIN w USING (content_hash) WHERE r.ord <> w.winner_ord""".replace("\n,\na AS", ",\na AS"))

oracle("storage_path", _with(Q.ART) + f"SELECT ord, {Q.storage_path('title', 'fetched_at')} AS stored_path FROM art")
oracle("slug", _with(Q.ART) + f"SELECT 'art' AS tbl, ord, {Q.lib_slug('title')} AS slug FROM art")
oracle("story_id", _with(Q.ART) + f"SELECT ord, {Q.story_id('title', 'ord')} AS story_id FROM art")
oracle("tag_default", _with(Q.ART) + """
SELECT ord, CASE WHEN tags[1] <> 'en' THEN tags[1] ELSE 'reading-list' END AS tags FROM art""")

# ------------------------------------------------------------- B1-B3, B6

oracle("page_meta", _with(Q.PG) + f"""
SELECT ord, {Q.page_title('html')} AS title, {Q.page_author('html')} AS author,
       {Q.page_date('html')} AS published_date FROM pg""")
oracle("page_text", _with(Q.PG) + f"""
SELECT ord, x_text AS text FROM (SELECT ord, {_sel(Q.main_text_steps('html', 'x'))} FROM pg)""")
oracle("page_extract", _with(Q.PG, Q.extract_cte()) + "SELECT ord, title, text, word_count FROM ex")
oracle("quality_gate", _with(Q.PG, Q.extract_cte()) + """
SELECT ord, word_count, CASE WHEN word_count < 50 THEN 'Too little content extracted' END AS error FROM ex""")

# ------------------------------------------------ F1-F3, E2, G2, A7, A8

SUMS = f"sums AS (SELECT *, {_sel(Q.summary_steps('content', 'title', 'sm'))} FROM art)"
LIB = Q.library_cte("lib")

oracle("summary_parts", _with(Q.ART, SUMS) + """
SELECT ord, sm_tldr AS tldr, sm_quote AS quote, sm_words AS n_words, sm_nsent AS n_sentences FROM sums""")
oracle("summary_md", _with(Q.ART, SUMS) + "SELECT ord, sm_md AS summary FROM sums")
_PROMPT_HEAD, _PROMPT_TAIL = __import__("broadsheet.operators.summarize", fromlist=["x"]).SUMMARY_PROMPT.split("{text}")
oracle("llm_requests", _with(Q.ART) + f"""
SELECT ord, {Q.q(_PROMPT_HEAD)} || CASE WHEN length(content) > 15000
         THEN substr(content, 1, 15000) || {Q.q(chr(10) * 2 + '[Content truncated...]')} ELSE content END
       || {Q.q(_PROMPT_TAIL)} AS request,
       length(content) > 15000 AS truncated FROM art""")
oracle("llm_replies", _with(Q.ART) + """,
r AS (SELECT ord, title, ord % 7 AS kind, CASE WHEN ord % 7 = 1 THEN '# ' || title || chr(10) ELSE '' END || split_part(content, chr(10), 1) AS reply FROM art)
SELECT ord, CASE WHEN kind IN (5, 6) THEN NULL
                 WHEN title <> '' AND NOT starts_with(reply, '# ' || title) THEN '# Summary: ' || title || chr(10) || chr(10) || reply
                 ELSE reply END AS summary,
       CASE WHEN kind = 5 THEN 'Failed to generate summary: timeout' END AS summary_error, kind = 6 AS pending FROM r""".replace("\n,\nr AS", ",\nr AS"))
oracle("tldr", _with(Q.ART, SUMS) + f"SELECT ord, {Q.tldr('sm_md')} AS tldr FROM sums")
oracle("daily_totals", _with(Q.ART, KEYED, LIB) + """
SELECT CAST(fetched_at AS DATE) AS day, count(*) AS articles, CAST(sum(word_count) AS BIGINT) AS total_words
FROM lib GROUP BY 1""")
oracle("daily_digest", _with(Q.ART, KEYED, LIB) + f""",
tot AS (SELECT CAST(fetched_at AS DATE) AS day, count(*) AS articles, sum(word_count) AS total_words FROM lib GROUP BY 1)
SELECT day, 0 AS part, NULL::TIMESTAMP AS fetched_at, '' AS url_hash,
  '# Daily Reading Digest: ' || strftime(day, '%Y-%m-%d') || {Q.q(chr(10) * 2 + '*Generated: 2024-02-01T00:00:00*' + chr(10) * 2)} ||
  '## Summary' || {Q.q(chr(10) * 2)} || '- **Articles ingested**: ' || CAST(articles AS VARCHAR) || {Q.q(chr(10))} ||
  '- **Total words**: ' || {Q.thousands('total_words')} || {Q.q(chr(10) * 2 + '---' + chr(10) * 2 + '## Articles' + chr(10))} AS text
FROM tot
UNION ALL
SELECT CAST(fetched_at AS DATE), 1, fetched_at, url_hash,
  '### ' || title || {Q.q(chr(10) * 2)} || '- **URL**: [' || url || '](' || url || ')' || {Q.q(chr(10))} ||
  '- **Words**: ' || {Q.thousands('word_count')} || {Q.q(chr(10))} || '- **Source**: ' || source || {Q.q(chr(10))} ||
  '- **Tags**: ' || CASE WHEN len(coalesce(tags, [])) > 0 THEN array_to_string(tags, ', ') ELSE 'none' END ||
  {Q.q(chr(10) * 2)} || '**Summary**: ' || {Q.tldr('summary')} || {Q.q(chr(10) * 2)} ||
  '[Read full summary](library/' || stored_path || '/summary.md)' || {Q.q(chr(10) * 2 + '---' + chr(10))}
FROM lib""".replace("\n,\ntot AS", ",\ntot AS"))
oracle("library_for_date", _with(Q.ART, KEYED, LIB) + """
SELECT ord, title, url, fetched_at, word_count FROM lib
WHERE year = '2024' AND month = '01' AND CAST(fetched_at AS DATE) = DATE '2024-01-01'""")
oracle("library_stored", _with(Q.ART, KEYED, LIB) + """
SELECT url_hash, title, url, fetched_at, word_count, source FROM lib WHERE CAST(fetched_at AS DATE) = DATE '2024-01-01'""")
oracle("fetch_order", _with(Q.ART, KEYED, LIB) + """
SELECT CAST(fetched_at AS DATE) AS day, fetched_at, url_hash,
       row_number() OVER (PARTITION BY CAST(fetched_at AS DATE) ORDER BY fetched_at, url_hash) AS position FROM lib""")
oracle("library_items", _with(Q.ART, KEYED, LIB) + """
SELECT url_hash, title, url, source, coalesce(nullif(published_date, ''), strftime(fetched_at, '%Y-%m-%d')) AS date,
       array_to_string(tags, ',') AS tags FROM lib""")

# ------------------------------------------ digest document and its queries

DG_HEAD = _with(Q.ART, KEYED, LIB, Q.DIGEST_CTES)
TERMS = "terms AS (SELECT term, lower(trim(term)) AS q FROM (VALUES ('src1'), ('OpenAI'), (' le '), ('the'), ('zzz-none')) t(term) WHERE trim(term) <> '')"

oracle("story_cards", DG_HEAD + """
SELECT day, rank, id, title, subtitle, url, source, date, section, one_liner,
       array_to_string(bullets, '|') AS bullets, read_time_min, array_to_string(tags, ',') AS tags FROM cards""")
oracle("sections", DG_HEAD + """
SELECT day, section AS name, min(rank) OVER (PARTITION BY day, section) AS first_rank,
       row_number() OVER (PARTITION BY day, section ORDER BY rank) - 1 AS pos, id AS ref_id,
       array_to_string(item_tags, ',') AS tags FROM cards""")
oracle("tag_index", DG_HEAD + "SELECT day, tag, id, rank FROM tidx")
oracle("digest_stats", DG_HEAD + """
SELECT i.day, CAST(i.n AS INTEGER) AS items_in, CAST(coalesce(c.n, 0) AS INTEGER) AS items_kept,
       CAST(coalesce(c.n, 0) AS INTEGER) AS top_stories_count, 0 AS duplicates_count
FROM (SELECT day, count(*) AS n FROM items GROUP BY day) i
LEFT JOIN (SELECT day, count(*) AS n FROM cards GROUP BY day) c USING (day)""")
oracle("mock_digest", DG_HEAD + """
SELECT i.day, 'v1' AS schema_version, '2024-02-01' AS generated_at, CAST(i.n AS INTEGER) AS items_in,
       CAST(c.n AS INTEGER) AS items_kept, CAST(c.n AS INTEGER) AS n_stories, 1 AS n_sections, c.ids AS story_ids, 0 AS n_tags
FROM (SELECT day, count(*) AS n FROM items GROUP BY day) i
JOIN (SELECT day, count(*) AS n, string_agg(id, ',' ORDER BY rank) AS ids FROM cards GROUP BY day) c USING (day)""")
oracle("digest_payload", DG_HEAD + """
SELECT day, rank, to_json({'title': title, 'url': url, 'source': source, 'date': date,
  'content': CASE WHEN length(content) > 3000 THEN substr(content, 1, 3000) || '…' ELSE content END,
  'tags': coalesce(tags, [])}) AS payload FROM ranked""")
oracle("digest_request", DG_HEAD + """
SELECT r.day, 'items = [' || string_agg(to_json({'title': title, 'url': url, 'source': source, 'date': date,
  'content': CASE WHEN length(content) > 3000 THEN substr(content, 1, 3000) || '…' ELSE content END,
  'tags': coalesce(tags, [])}), ', ' ORDER BY rank) || ']' || chr(10) || chr(10) || '共 ' || any_value(n.n)
  || ' 条原始输入，上面是 pre-rank 后的 Top ' || count(*) || ' 条。' AS payload
FROM ranked r JOIN (SELECT day, count(*) AS n FROM items GROUP BY day) n ON n.day = r.day GROUP BY r.day""")
oracle("items_fingerprint", DG_HEAD + Q.fingerprint_sql("ranked"))
oracle("cache_lookup", DG_HEAD + f""",
hitems AS (SELECT * FROM items WHERE coalesce(ord IN (SELECT ord FROM lib WHERE coalesce(published_date < '2024-01-17', false)), false)),
hscored AS (SELECT *, {", ".join(Q.date_steps('date', 'dt'))},
         {Q.source_weight('source', 'url')} AS sw, {Q.freshness('dt')} AS fr, {Q.length_score('content', 'snippet')} AS ls,
         {Q.score('sw', 'fr', 'ls')} AS score FROM hitems),
hranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, ord ASC) AS rank FROM hscored) WHERE rank <= 30),
cur AS ({Q.fingerprint_sql('ranked')}),
hist_fp AS ({Q.fingerprint_sql('hranked')})
SELECT day, fingerprint, fingerprint IN (SELECT fingerprint FROM hist_fp) AS hit FROM cur""".replace("\n,\nhitems", ",\nhitems"))
oracle("cache_put", ORACLE["cache_lookup"].rsplit("SELECT day, fingerprint, fingerprint IN", 1)[0] + """
SELECT fingerprint, max(run) AS run, arg_max(run || ':' || CAST(day AS VARCHAR), run) AS doc
FROM (SELECT fingerprint, 'r1' AS run, day FROM hist_fp UNION ALL SELECT fingerprint, 'r2', day FROM cur) GROUP BY fingerprint""")
oracle("reply_fallback", DG_HEAD + """
SELECT day, CASE WHEN day(day) % 2 = 0 THEN 'reply' ELSE 'mock' END AS origin,
       CASE WHEN day(day) % 2 = 0 THEN '2024-02-02' ELSE '2024-02-01' END AS generated_at, CAST(count(*) AS INTEGER) AS n_stories
FROM cards GROUP BY day""")
oracle("digest_written", DG_HEAD + """
SELECT i.day, 'v1' AS schema_version, '2024-02-01' AS generated_at, CAST(i.n AS INTEGER) AS items_in, CAST(c.n AS INTEGER) AS n_stories
FROM (SELECT day, count(*) AS n FROM items GROUP BY day) i JOIN (SELECT day, count(*) AS n FROM cards GROUP BY day) c USING (day)""")
oracle("digest_validate", DG_HEAD + "SELECT day, true AS valid, CAST(count(*) AS INTEGER) AS n_stories FROM cards GROUP BY day")
oracle("digest_integrity", DG_HEAD + """
SELECT day, day(day) % 4 = 0 AS search_summaries_ok,
       count(*) FILTER (WHERE refs <> 1 OR day(day) % 4 = 2) AS not_one_section, CASE WHEN day(day) % 4 = 3 THEN 2 ELSE 0 END AS dangling_tag_ids,
       count(*) FILTER (WHERE url IN ('', 'unknown') OR date IN ('', 'unknown') OR (day(day) % 4 = 1 AND rank = 1)) AS missing_url_or_date
FROM (SELECT c.*, count(*) OVER (PARTITION BY day, id) AS refs FROM cards c) GROUP BY day""")
oracle("trending", _with(Q.ART) + f""",
w AS (SELECT * FROM (SELECT *, {_sel(Q.date_steps('date', 'dt'))} FROM art)
      WHERE CAST(dt_ts AS DATE) BETWEEN DATE '2024-01-25' AND DATE '2024-01-31'),
pairs AS (SELECT DISTINCT unnest(tags) AS entity, source FROM w)
SELECT entity, count(*) AS n_sources FROM pairs GROUP BY entity HAVING count(*) >= 3""".replace("\n,\nw AS", ",\nw AS"))
oracle("trending_daily", _with(Q.ART) + f""",
w AS (SELECT *, CAST(dt_ts AS DATE) AS d FROM (SELECT *, {_sel(Q.date_steps('date', 'dt'))} FROM art) WHERE dt_ts IS NOT NULL),
mentions AS (SELECT unnest(tags) AS entity, source, d FROM w),
days AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM w), (SELECT max(d) + 6 FROM w), INTERVAL 1 DAY)) AS DATE) AS day),
pairs AS (SELECT DISTINCT y.day, m.entity, m.source FROM days y JOIN mentions m ON m.d BETWEEN y.day - 6 AND y.day)
SELECT day, entity, count(*) AS n_sources FROM pairs GROUP BY day, entity HAVING count(*) >= 3""".replace("\n,\nw AS", ",\nw AS"))
oracle("window7", _with(Q.ART) + f"""
SELECT ord, date FROM (SELECT ord, date, {_sel(Q.date_steps('date', 'dt'))} FROM art)
WHERE CAST(dt_ts AS DATE) BETWEEN DATE '2024-01-25' AND DATE '2024-01-31'""")
oracle("story_search", DG_HEAD + ",\n" + TERMS + """
SELECT c.day, t.term, c.rank, c.id FROM cards c, terms t
WHERE contains(lower(c.title), t.q) OR contains(lower(c.one_liner), t.q)
   OR len(list_filter(c.tags, lambda x: contains(lower(x), t.q))) > 0
   OR contains(lower(c.subtitle), t.q) OR contains(lower(c.source), t.q)""")
oracle("hint_search", DG_HEAD + ",\n" + TERMS + """,
hints AS (SELECT day, tag AS query_hint, [tag] AS matching_tags, list(id ORDER BY rank) AS top_refs FROM tidx GROUP BY day, tag)
SELECT h.day, t.term, h.query_hint, unnest(h.top_refs) AS ref_id FROM hints h, terms t
WHERE contains(lower(h.query_hint), t.q) OR len(list_filter(h.matching_tags, lambda x: contains(lower(x), t.q))) > 0""")
oracle("tag_filter", DG_HEAD + """,
rows_ AS (SELECT day, 'story' AS kind, CAST(rank AS VARCHAR) AS place, id FROM cards
         UNION ALL SELECT day, 'section', section, id FROM cards)
SELECT day, kind, place, id, 'all' AS tag FROM rows_
UNION ALL
SELECT c.day, c.kind, c.place, c.id, i.tag FROM rows_ c
JOIN (SELECT DISTINCT day, tag, id FROM tidx WHERE tag IN ('en', 'src3', 'no-such-tag')) i ON i.day = c.day AND i.id = c.id""".replace("\n,\nrows_", ",\nrows_"))
oracle("facets", DG_HEAD + """
SELECT day, tag, row_number() OVER (PARTITION BY day ORDER BY tag) AS pos FROM (SELECT DISTINCT day, tag FROM tidx)""")
oracle("section_facets", DG_HEAD + "SELECT day, section AS name, count(*) AS items FROM cards GROUP BY day, section")
oracle("report_rows", DG_HEAD + "SELECT day, row_number() OVER (PARTITION BY day ORDER BY rank) AS n, id, title FROM cards")

# ------------------------------------------------- sources, feeds, ingest

FEEDS = f"""pgt AS (
  SELECT ord, url, coalesce({Q.page_title('html')}, '') AS t,
         lower(regexp_extract(regexp_replace(regexp_replace(url, '^[\\x{{00}}-\\x{{20}}]+', ''), '[\\t\\r\\n]', '', 'g'),
                              {Q.q(Q.SPLIT_RE)}, 2)) AS host FROM pg),
fe AS (
  SELECT 'https://' || host || '/feed.xml?page=' || CAST(CAST(floor(ord / 20) AS BIGINT) AS VARCHAR) AS feed_url,
         ord, url, CASE WHEN floor(ord / 20) % 6 = 2 THEN trim(t || ' R&D' || chr(160) || 'x') ELSE t END AS t FROM pgt),
fitems AS (
  SELECT feed_url, CAST(row_number() OVER (PARTITION BY feed_url ORDER BY ord) - 1 AS INTEGER) AS pos,
         coalesce(nullif(t, ''), 'Untitled') AS title, url AS link, NULL::VARCHAR AS published,
         min(ord) OVER (PARTITION BY feed_url) AS first_ord FROM fe),
exp AS (
  SELECT first_ord AS source_ord, pos, feed_url AS source_url, link AS url, count(*) OVER (PARTITION BY feed_url) AS n_entries FROM fitems
  UNION ALL
  SELECT ord + 1000000000, 0, url, url, 1 FROM pg)"""

oracle("src_list", _with(Q.PG, FEEDS) + """
SELECT DISTINCT first_ord AS source_ord, feed_url AS source_url FROM fitems
UNION ALL SELECT ord + 1000000000, url FROM pg""")
oracle("feed_items", _with(Q.PG, FEEDS) + "SELECT feed_url, pos, title, link, published FROM fitems")
oracle("feed_limit", _with(Q.PG, FEEDS) + "SELECT feed_url, pos, title, link, published FROM fitems WHERE pos < 1")
oracle("expand_sources", _with(Q.PG, FEEDS) + "SELECT source_ord, pos, source_url, url, n_entries FROM exp")
oracle("source_type", _with(Q.PG, FEEDS) + """
SELECT source_ord, pos, url, CASE WHEN count(*) OVER (PARTITION BY source_ord) > 1 THEN 'rss' ELSE 'manual' END AS source_type FROM exp""")
oracle("items_scan", _with(Q.ART) + """
SELECT source, CAST(floor(ord / 100) AS BIGINT) AS part, true AS valid,
       CAST(row_number() OVER (PARTITION BY source, floor(ord / 100) ORDER BY ord) - 1 AS INTEGER) AS pos,
       title, url, date FROM art""")

def _ingest_sql(history: bool) -> str:
    """Outcomes of the sources file as ``outc``; with history every seventh page is in the log and every eleventh line forced."""
    log = f"""hx AS (SELECT ord, url, html FROM pg WHERE {'ord % 7 = 0' if history else 'false'}),
{Q.extract_cte('hx', 'hex')},
hist AS (SELECT ord, title, sha256(u_norm) AS url_hash, {Q.content_hash('text')} AS content_hash
         FROM (SELECT *, {", ".join(Q.url_steps('url', 'u'))} FROM hex)),
latest AS (SELECT url_hash, arg_max(content_hash, ord) AS content_hash FROM hist GROUP BY url_hash)"""
    forced = "source_ord >= 1000000000 AND source_ord % 11 = 0" if history else "false"
    sql = _with(Q.PG, FEEDS, log) + f""",
typed AS (SELECT *, row_number() OVER (ORDER BY source_ord, pos) AS ord FROM exp),
pbu AS (SELECT 0 AS ord, url, arg_min(html, ord) AS html FROM pg GROUP BY url),
{Q.extract_cte('pbu', 'ex')},
rows AS (SELECT t.*, e.title, e.text, e.word_count FROM typed t LEFT JOIN ex e USING (url)),
k2 AS (SELECT ord, source_ord, pos, url, title, text, word_count, sha256(u_norm) AS url_hash, {Q.content_hash('text')} AS content_hash
       FROM (SELECT *, {", ".join(Q.url_steps('url', 'u'))} FROM rows)),
keys AS (SELECT ord, url_hash AS u, CASE WHEN coalesce(text, '') <> '' THEN content_hash END AS cc,
                content_hash AS rc, {forced} AS forced FROM k2 WHERE text IS NOT NULL AND word_count >= 50),
{Q.walk_ctes('keys', "coalesce((SELECT list(url_hash ORDER BY url_hash) FROM latest), []::VARCHAR[])",
             "coalesce((SELECT list(content_hash ORDER BY url_hash) FROM latest), []::VARCHAR[])")},
outc AS (
  SELECT r.source_ord, r.pos, r.url, coalesce(w.keep, false) AS success,
         (r.text IS NOT NULL AND r.word_count >= 50 AND NOT coalesce(w.keep, false)) AS skipped,
         CASE WHEN r.text IS NULL THEN 'Failed to fetch URL: ' || r.url
              WHEN r.word_count < 50 THEN 'Too little content extracted' END AS error,
         CASE WHEN coalesce(w.keep, false) THEN {Q.storage_path('r.title', "TIMESTAMP '2024-02-01 08:00:00'")} END AS stored_path,
         CASE WHEN r.text IS NOT NULL AND r.word_count >= 50 THEN r.title END AS title
  FROM k2 r LEFT JOIN (SELECT ord, keep FROM walk WHERE i > 0) w ON w.ord = r.ord)
"""
    return sql.replace("\n,\ntyped", ",\ntyped").replace("WITH ", "WITH RECURSIVE ", 1)


INGEST = _ingest_sql(True)
oracle("ingest_batch", INGEST + "SELECT * FROM outc")
oracle("run_summary", INGEST + """
SELECT count(*) FILTER (WHERE success) AS ingested, count(*) FILTER (WHERE skipped) AS skipped,
       count(*) FILTER (WHERE NOT success AND NOT skipped) AS errors FROM outc""")
oracle("ingest_dry_run", _with(Q.PG, Q.extract_cte('pg', 'ex')) + f""",
k AS (SELECT *, sha256(u_norm) AS url_hash, {Q.content_hash('text')} AS content_hash, ord % 11 = 0 AS forced
      FROM (SELECT *, {", ".join(Q.url_steps('url', 'u'))} FROM ex)),
recs AS (SELECT * FROM k WHERE ord % 7 = 0),
latest AS (SELECT url_hash, min(ord) AS first_pos, arg_max(title, ord) AS title, arg_max(content_hash, ord) AS content_hash FROM recs GROUP BY url_hash),
byc AS (SELECT content_hash, arg_min(title, first_pos) AS content_title FROM latest GROUP BY content_hash),
why AS (SELECT k.*, CASE WHEN l.title IS NOT NULL THEN 'URL already seen: ' || l.title
          WHEN coalesce(k.text, '') <> '' AND c.content_title IS NOT NULL THEN 'Content matches existing: ' || c.content_title END AS reason0
        FROM k LEFT JOIN latest l ON l.url_hash = k.url_hash LEFT JOIN byc c ON c.content_hash = k.content_hash)
SELECT ord, url, title, coalesce(author, 'Unknown') AS author, word_count, 'reading-list' AS tags,
       substr(url_hash, 1, 16) AS url_hash16, substr(content_hash, 1, 16) AS content_hash16,
       word_count < 50 AS low_content_warning, forced, (reason0 IS NOT NULL AND NOT forced) AS is_dup,
       CASE WHEN NOT forced THEN reason0 END AS reason FROM why""".replace("\n,\nk AS", ",\nk AS"))
oracle("incremental_ingest", _ingest_sql(False) + "SELECT * FROM outc")

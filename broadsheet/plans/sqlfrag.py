"""DuckDB SQL fragments that restate the column functions for the oracle queries.

Each helper returns SQL text.  DuckDB resolves aliases defined earlier in the
same SELECT list, so multi-step functions are emitted as a list of
``expr AS alias`` items that build on each other.
"""

from __future__ import annotations

from broadsheet.functions.text import WS_CLASS
from broadsheet.functions.urls import TRACKING_PARAMS, USES_NETLOC, USES_PARAMS
from broadsheet.operators.rank import DEFAULT_WEIGHT, SOURCE_WEIGHTS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(vals) -> str:
    return "(" + ", ".join(q(v) for v in vals) + ")"


ART = f"""art AS (
  SELECT doc_id AS ord,
    'https://' || (CASE doc_id % 5 WHEN 0 THEN 'openai.com' WHEN 1 THEN 'arxiv.org'
                   WHEN 2 THEN 'GitHub.com' WHEN 3 THEN 'reddit.com:443' ELSE 'blog.example.com' END)
      || '/a/' || CAST(doc_id - CASE WHEN doc_id % 7 = 6 THEN 5 ELSE 0 END AS VARCHAR)
      || CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END
      || CASE WHEN doc_id % 4 = 0 THEN '?utm_source=x&id=1' ELSE '?id=1' END AS url,
    substr(split_part(text, chr(10), 1), 1, 60) AS title,
    text AS content,
    source,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 10) AS fetched_at,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'bad'
         ELSE strftime(DATE '2024-01-31' - CAST(doc_id % 45 AS INTEGER), '%Y-%m-%d') END AS date,
    [lang, source] AS tags
  FROM documents)"""

PG = "pg AS (SELECT page_id AS ord, url, html FROM pages)"

AS_OF_SQL = "TIMESTAMP '2024-01-31 12:00:00'"


def norm_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS_CLASS}+', ' ', 'g'))"


def ws_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def word_count(x: str) -> str:
    n = norm_ws(x)
    return f"CAST(CASE WHEN {n} = '' THEN 0 ELSE length({n}) - length(replace({n}, ' ', '')) + 1 END AS INTEGER)"


def norm_text(x: str) -> str:
    return norm_ws(f"lower({x})")


def content_hash(x: str) -> str:
    return f"sha256({norm_text(x)})"


SPLIT_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_steps(x: str, p: str) -> list[str]:
    """Select items computing ``{p}_scheme``, ``{p}_path`` (params-free), ``{p}_norm``."""
    r = SPLIT_RE
    return [
        f"regexp_replace(regexp_replace({x}, '^[\\x{{00}}-\\x{{20}}]+', ''), '[\\t\\r\\n]', '', 'g') AS {p}_u",
        f"lower(regexp_extract({p}_u, '{r}', 1)) AS {p}_scheme",
        f"lower(regexp_extract({p}_u, '{r}', 2)) AS {p}_nl0",
        f"regexp_extract({p}_u, '{r}', 3) AS {p}_rawpath",
        f"regexp_extract({p}_u, '{r}', 4) AS {p}_query",
        f"CASE WHEN {p}_scheme IN {in_list(USES_PARAMS)} AND contains({p}_rawpath, ';') THEN "
        f"(CASE WHEN contains({p}_rawpath, '/') THEN regexp_extract({p}_rawpath, '(?s)^(.*/[^;]*)', 1) "
        f"ELSE split_part({p}_rawpath, ';', 1) END) ELSE {p}_rawpath END AS {p}_path",
        f"CASE WHEN {p}_scheme = 'http' AND ends_with({p}_nl0, ':80') THEN substr({p}_nl0, 1, length({p}_nl0) - 3) "
        f"WHEN {p}_scheme = 'https' AND ends_with({p}_nl0, ':443') THEN substr({p}_nl0, 1, length({p}_nl0) - 4) "
        f"ELSE {p}_nl0 END AS {p}_nl",
        f"CASE WHEN {p}_path <> '/' AND ends_with({p}_path, '/') THEN regexp_replace({p}_path, '/+$', '') ELSE {p}_path END AS {p}_p2",
        f"array_to_string(list_filter(list_sort(string_split({p}_query, '&')), "
        f"lambda s: contains(s, '=') AND lower(split_part(s, '=', 1)) NOT IN {in_list(TRACKING_PARAMS)}), '&') AS {p}_q2",
        f"(CASE WHEN {p}_scheme <> '' THEN {p}_scheme || ':' ELSE '' END) || "
        f"(CASE WHEN {p}_nl <> '' THEN '//' || {p}_nl || (CASE WHEN {p}_p2 <> '' AND NOT starts_with({p}_p2, '/') THEN '/' || {p}_p2 ELSE {p}_p2 END) "
        f"WHEN starts_with({p}_p2, '//') THEN '//' || {p}_p2 "
        f"WHEN {p}_scheme <> '' AND {p}_scheme IN {in_list(USES_NETLOC)} AND ({p}_p2 = '' OR starts_with({p}_p2, '/')) THEN '//' || {p}_p2 "
        f"ELSE {p}_p2 END) || (CASE WHEN {p}_q2 <> '' THEN '?' || {p}_q2 ELSE '' END) AS {p}_norm",
    ]


def source_weight(src: str, url: str) -> str:
    s = f"lower(coalesce({src}, ''))"
    u = f"lower({url})"
    branches = " ".join(f"WHEN contains({s}, {q(k)}) OR contains({u}, {q(k)}) THEN {w}" for k, w in SOURCE_WEIGHTS)
    return f"CAST(CASE {branches} ELSE {DEFAULT_WEIGHT} END AS INTEGER)"


def length_score(content: str, snippet: str | None = None) -> str:
    parts = [f"nullif({content}, '')"] + ([f"nullif({snippet}, '')"] if snippet else [])
    n = f"length(coalesce({', '.join(parts)}, ''))"
    return (f"(CASE WHEN {n} > 5000 THEN 5.0 WHEN {n} > 2000 THEN 4.0 WHEN {n} > 500 THEN 3.0 "
            f"WHEN {n} > 100 THEN 2.0 ELSE 1.0 END)::DOUBLE")


_Y, _M, _D = r"(\d{4})", r"(1[0-2]|0[1-9]|[1-9])", r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
_H, _MI, _S = r"(2[0-3]|[01]\d|\d)", r"([0-5]\d|\d)", r"([0-5]\d|\d)"
DATE_RE = "^" + _Y + "-" + _M + "-" + _D + "$"
DATETIME_RE = "(?i)^" + _Y + "-" + _M + "-" + _D + "T" + _H + ":" + _MI + ":" + _S + "Z?$"


def date_steps(x: str, p: str) -> list[str]:
    """Select items computing ``{p}_ts`` (parsed timestamp or NULL)."""
    return [
        f"substr({x}, 1, 19) AS {p}_s",
        f"regexp_matches({p}_s, '{DATE_RE}') AS {p}_isd",
        f"regexp_matches({p}_s, '{DATETIME_RE}') AS {p}_isdt",
        f"CASE WHEN {p}_isd THEN CAST(regexp_extract({p}_s, '{DATE_RE}', 1) AS INTEGER) "
        f"WHEN {p}_isdt THEN CAST(regexp_extract({p}_s, '{DATETIME_RE}', 1) AS INTEGER) END AS {p}_y",
        f"CASE WHEN {p}_isd THEN CAST(regexp_extract({p}_s, '{DATE_RE}', 2) AS INTEGER) "
        f"WHEN {p}_isdt THEN CAST(regexp_extract({p}_s, '{DATETIME_RE}', 2) AS INTEGER) END AS {p}_m",
        f"CASE WHEN {p}_isd THEN CAST(trim(regexp_extract({p}_s, '{DATE_RE}', 3)) AS INTEGER) "
        f"WHEN {p}_isdt THEN CAST(trim(regexp_extract({p}_s, '{DATETIME_RE}', 3)) AS INTEGER) END AS {p}_d",
        f"CASE WHEN {p}_isdt AND NOT {p}_isd THEN CAST(regexp_extract({p}_s, '{DATETIME_RE}', 4) AS INTEGER) ELSE 0 END AS {p}_hh",
        f"CASE WHEN {p}_isdt AND NOT {p}_isd THEN CAST(regexp_extract({p}_s, '{DATETIME_RE}', 5) AS INTEGER) ELSE 0 END AS {p}_mi",
        f"CASE WHEN {p}_isdt AND NOT {p}_isd THEN CAST(regexp_extract({p}_s, '{DATETIME_RE}', 6) AS INTEGER) ELSE 0 END AS {p}_ss",
        f"CASE WHEN {p}_y >= 1 AND {p}_d <= day(last_day(make_date({p}_y, {p}_m, 1))) "
        f"THEN make_timestamp({p}_y, {p}_m, {p}_d, {p}_hh, {p}_mi, {p}_ss) END AS {p}_ts",
    ]


def freshness(p: str, as_of: str = AS_OF_SQL) -> str:
    """Freshness from ``{p}_ts`` produced by :func:`date_steps`."""
    age = f"CAST(floor((epoch({as_of}) - epoch({p}_ts)) / 86400.0) AS BIGINT)"
    return (f"(CASE WHEN {p}_ts IS NULL THEN 2.0 WHEN {age} <= 1 THEN 5.0 WHEN {age} <= 3 THEN 4.0 "
            f"WHEN {age} <= 7 THEN 3.0 WHEN {age} <= 30 THEN 2.0 ELSE 1.0 END)::DOUBLE")


def score(w: str, f: str, l: str) -> str:
    return f"(0.4::DOUBLE * {w} + 0.3::DOUBLE * {f} + 0.3::DOUBLE * {l})"


def lib_slug(x: str, max_length: int = 50) -> str:
    s0 = (f"regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x{{00}}-\\x{{7f}}]', '', 'g')), "
          f"'[^a-z0-9]+', '-', 'g')")
    s1 = f"regexp_replace({s0}, '^-+|-+$', '', 'g')"
    h = f"substr({s1}, 1, {max_length})"
    cut = f"(CASE WHEN contains({h}, '-') THEN regexp_extract({h}, '^(.*)-', 1) ELSE {h} END)"
    return f"coalesce(nullif(CASE WHEN length({s1}) > {max_length} THEN {cut} ELSE {s1} END, ''), 'untitled')"


def story_slug(x: str) -> str:
    s = f"regexp_replace(lower({ws_strip(x)}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '-', 'g')"
    return f"substr(regexp_replace({s}, '^-+|-+$', '', 'g'), 1, 60)"


def story_id(title: str, idx: str) -> str:
    return f"coalesce(nullif({story_slug(title)}, ''), 'item-' || CAST({idx} AS VARCHAR))"


def storage_path(title: str, ts: str) -> str:
    return f"strftime({ts}, '%Y/%m/') || {lib_slug(title)} || '-' || strftime({ts}, '%H%M%S')"


def keyed_cte(src: str = "art", name: str = "keyed") -> str:
    """``{name}``: article rows plus url_hash and content_hash."""
    return f"""{name} AS (
  SELECT ord, url, title, content, source, fetched_at, date, tags,
         sha256(u_norm) AS url_hash, {content_hash('content')} AS content_hash
  FROM (SELECT *, {", ".join(url_steps('url', 'u'))} FROM {src}))"""


HIST = "coalesce(date < '2024-01-17', false)"


def seen_recs_cte(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT ord AS pos, url, url_hash, content_hash, title, fetched_at,
         {storage_path('title', 'fetched_at')} AS stored_path,
         CASE WHEN ord % 5 = 4 THEN 'manual' ELSE 'rss' END AS source
  FROM {src})"""


def latest_cte(recs: str, name: str) -> str:
    return f"""{name} AS (
  SELECT url_hash, min(pos) AS first_pos, arg_max(url, pos) AS url, arg_max(content_hash, pos) AS content_hash,
         arg_max(title, pos) AS title, arg_max(fetched_at, pos) AS fetched_at,
         arg_max(stored_path, pos) AS stored_path, arg_max(source, pos) AS source
  FROM {recs} GROUP BY url_hash)"""


def walk_ctes(keys: str, su0: str = "[]::VARCHAR[]", sc0: str = "[]::VARCHAR[]") -> str:
    """Sequential first-wins walk over ``keys(ord, u, cc, rc, forced)`` -> ``walk(i, ord, keep)``.

    One recursion step per row in ord order, carrying the urls on record and,
    at the same places, the content hash of each one's latest record: the
    literal statement of the rule, independent of rounds.
    """
    ok = "(k.forced OR NOT (list_contains(w.su, k.u) OR (k.cc IS NOT NULL AND list_contains(w.sc, k.cc))))"
    return f"""kk AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ord) AS i, ord, u, cc, rc, forced FROM {keys}),
walk AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::BOOLEAN AS keep, {su0} AS su, {sc0} AS sc
  UNION ALL
  SELECT k.i, k.ord, {ok},
         CASE WHEN {ok} AND NOT list_contains(w.su, k.u) THEN list_append(w.su, k.u) ELSE w.su END,
         CASE WHEN NOT {ok} THEN w.sc
              WHEN list_contains(w.su, k.u) THEN
                w.sc[:list_position(w.su, k.u) - 1] || [k.rc] || w.sc[list_position(w.su, k.u) + 1:]
              ELSE list_append(w.sc, k.rc) END
  FROM walk w JOIN kk k ON k.i = w.i + 1)"""


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]
TAG_RE = r"<(?:/?[A-Za-z][^>]*|![^>]*|\?[^>]*)>"


def decode_entities(x: str) -> str:
    for e, ch in ENTITIES:
        x = f"replace({x}, {q(e)}, {q(ch)})"
    return x


def main_text(html: str) -> str:
    s = f"regexp_replace({html}, '(?s)<!--.*?-->', ' ', 'g')"
    for t in ["script", "style", "nav", "header", "footer", "aside"]:
        s = f"regexp_replace({s}, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g')"
    return s


def main_text_steps(html: str, p: str) -> list[str]:
    return [
        f"{main_text(html)} AS {p}_s",
        f"CASE WHEN regexp_matches({p}_s, '(?i)<article\\b') THEN regexp_extract({p}_s, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1) "
        f"WHEN regexp_matches({p}_s, '(?i)<main\\b') THEN regexp_extract({p}_s, '(?is)<main\\b[^>]*>(.*?)</main\\s*>', 1) "
        f"WHEN regexp_matches({p}_s, '(?i)<body\\b') THEN regexp_extract({p}_s, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|\\z)', 1) "
        f"ELSE {p}_s END AS {p}_span",
        f"{norm_ws(decode_entities(f'regexp_replace({p}_span, {q(TAG_RE)}, {q(chr(32))}, {q(chr(103))})'))} AS {p}_text",
    ]


def meta_content(html: str, attr: str, value: str) -> str:
    tag = f"regexp_extract({html}, '(?is)<meta\\b[^>]*\\b{attr}\\s*=\\s*(?:\"(?-i:{value})\"|''(?-i:{value})'')[^>]*>', 0)"
    dq = f"regexp_extract({tag}, '(?is)\\bcontent\\s*=\\s*\"([^\"]*)\"', 1)"
    sq = f"regexp_extract({tag}, '(?is)\\bcontent\\s*=\\s*''([^'']*)''', 1)"
    raw = (f"(CASE WHEN regexp_matches({tag}, '(?is)\\bcontent\\s*=\\s*\"') THEN {dq} "
           f"WHEN regexp_matches({tag}, '(?is)\\bcontent\\s*=\\s*''') THEN {sq} END)")
    return f"(CASE WHEN {tag} <> '' THEN {decode_entities(raw)} END)"


def truthy_strip(raw: str) -> str:
    return f"(CASE WHEN coalesce({raw}, '') <> '' THEN {ws_strip(raw)} END)"


def page_title(html: str) -> str:
    t = (f"(CASE WHEN regexp_matches({html}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>') THEN "
         f"{ws_strip(decode_entities(f'regexp_extract({html}, {q(chr(40) + chr(63) + "is)<title" + chr(92) + "b[^>]*>(.*?)</title" + chr(92) + "s*>")}, 1)'))} END)")
    return f"coalesce({truthy_strip(meta_content(html, 'property', 'og:title'))}, {t})"


def page_author(html: str) -> str:
    return (f"coalesce({truthy_strip(meta_content(html, 'property', 'article:author'))}, "
            f"{truthy_strip(meta_content(html, 'name', 'author'))})")


def page_date(html: str) -> str:
    pub = truthy_strip(meta_content(html, "property", "article:published_time"))
    alt = truthy_strip(meta_content(html, "name", "date"))
    return f"(CASE WHEN coalesce({pub}, '') <> '' THEN {pub} ELSE coalesce({alt}, {pub}) END)"


def extract_cte(src: str = "pg", name: str = "ex") -> str:
    """``{name}``: pages with title, author, published_date, text, word_count."""
    return f"""{name} AS (
  SELECT ord, url, html,
    coalesce(nullif({page_title('html')}, ''), 'Untitled') AS title,
    {page_author('html')} AS author, {page_date('html')} AS published_date,
    coalesce(x_text, '') AS text, {word_count('coalesce(x_text, ' + q('') + ')')} AS word_count
  FROM (SELECT *, {", ".join(main_text_steps('html', 'x'))} FROM {src}))"""


_WS_IN = WS_CLASS[1:-1]
SENTENCE_RE = "[^.!?" + _WS_IN + "](?:[^.!?]*[^.!?" + _WS_IN + "])?"
TLDR_RE = "(?s)## TL;DR" + WS_CLASS + "*\n(.+?)(?:\n##|\n---|\\z)"


def thousands(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def summary_steps(text: str, title: str, p: str) -> list[str]:
    from broadsheet.operators.summarize import (MOCK_FOOTER, MOCK_NOTE, MOCK_SECTIONS, NO_CONTENT,
                                                NO_QUOTE, PROBLEM_LINE, UNTITLED_ARTICLE)
    secs = "".join(f"## {h}\n{l}\n\n" for h, l in MOCK_SECTIONS)
    return [
        f"regexp_extract_all(coalesce({text}, ''), {q(SENTENCE_RE)}) AS {p}_s",
        f"array_to_string({p}_s[1:3], ' ') AS {p}_first",
        f"CASE WHEN len({p}_s) = 0 THEN {q(NO_CONTENT)} WHEN length({p}_first) > 500 "
        f"THEN substr({p}_first, 1, 500) || '...' ELSE {p}_first END AS {p}_tldr",
        f"CASE WHEN len(list_filter({p}_s, lambda x: length(x) > 50)) > 0 "
        f"THEN '\"' || list_filter({p}_s, lambda x: length(x) > 50)[1] || '\"' END AS {p}_quote",
        f"{word_count('coalesce(' + text + ', ' + q('') + ')')} AS {p}_words",
        f"CAST(len({p}_s) AS INTEGER) AS {p}_nsent",
        f"'# Summary: ' || coalesce(nullif({title}, ''), {q(UNTITLED_ARTICLE)}) || "
        f"{q(chr(10) * 2 + MOCK_NOTE + chr(10) * 2 + '## TL;DR' + chr(10))} || {p}_tldr || "
        f"{q(chr(10) * 2 + '## Problem/Motivation' + chr(10) + PROBLEM_LINE + chr(10) * 2 + 'This article contains approximately ')} || "
        f"{thousands(p + '_words')} || ' words and ' || CAST({p}_nsent AS VARCHAR) || {q(' sentences.' + chr(10) * 2)} || "
        f"{q(secs + '## Key Quotes' + chr(10))} || coalesce({p}_quote, {q(NO_QUOTE)}) || "
        f"{q(chr(10) * 2 + '---' + chr(10) + MOCK_FOOTER + chr(10))} AS {p}_md",
    ]


def tldr(md: str) -> str:
    return (f"(CASE WHEN contains({md}, '## TL;DR') AND regexp_matches({md}, {q(TLDR_RE)}) "
            f"THEN {ws_strip(f'regexp_extract({md}, {q(TLDR_RE)}, 1)')} ELSE 'Summary not available.' END)")


def library_cte(name: str = "lib") -> str:
    """``{name}``: every article as a stored library row (needs ``keyed``)."""
    return f"""{name} AS (
  SELECT ord, title, NULL::VARCHAR AS author, date AS published_date, url, url_hash, content_hash, fetched_at,
         {word_count('content')} AS word_count, tags,
         CASE WHEN ord % 5 = 4 THEN 'manual' ELSE 'rss' END AS source,
         content, sm_md AS summary, strftime(fetched_at, '%Y') AS year, strftime(fetched_at, '%m') AS month,
         {storage_path('title', 'fetched_at')} AS stored_path
  FROM (SELECT *, {", ".join(summary_steps('content', 'title', 'sm'))} FROM keyed))"""


def json_escape(x: str) -> str:
    x = f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        x = f"replace({x}, chr({code}), {q(named.get(code, chr(92) + 'u%04x' % code))})"
    return x


DIGEST_CTES = f"""items AS (
  SELECT CAST(fetched_at AS DATE) AS day, ord, title, url, source,
         coalesce(nullif(published_date, ''), strftime(fetched_at, '%Y-%m-%d')) AS date,
         NULL::VARCHAR AS snippet, content, author, tags FROM lib),
scored AS (
  SELECT *, {", ".join(date_steps('date', 'dt'))},
         {source_weight('source', 'url')} AS sw, {freshness('dt')} AS fr, {length_score('content', 'snippet')} AS ls,
         {score('sw', 'fr', 'ls')} AS score FROM items),
ranked AS (SELECT * FROM (SELECT day, ord, title, url, source, date, snippet, content, author, tags, score,
             row_number() OVER (PARTITION BY day ORDER BY score DESC, ord ASC) AS rank FROM scored) WHERE rank <= 30),
cards AS (
  SELECT day, rank, {story_id('title', 'rank - 1')} AS id, title, substr(title, 1, 40) AS subtitle, url,
         coalesce(nullif(source, ''), 'unknown') AS source, coalesce(nullif(date, ''), 'unknown') AS date,
         'Other' AS section, substr(title, 1, 26) AS one_liner,
         [substr(coalesce(nullif(snippet, ''), title), 1, 22),
          substr('来源: ' || coalesce(nullif(source, ''), 'unknown'), 1, 22),
          substr('日期: ' || coalesce(nullif(date, ''), 'unknown'), 1, 22)] AS bullets,
         greatest(1, CAST(floor(length(coalesce(nullif(content, ''), nullif(snippet, ''), '')) / 1500) AS INTEGER)) AS read_time_min,
         CASE WHEN len(coalesce(tags, [])) > 0 THEN tags ELSE ['untagged'] END AS tags,
         coalesce(tags, []) AS item_tags
  FROM ranked WHERE rank <= 12),
tidx AS (SELECT day, unnest(list_distinct(item_tags)) AS tag, id, rank FROM cards)"""


def fingerprint_sql(src: str) -> str:
    keys = f"list_sort(list(title || '|' || url))"
    return (f"SELECT day, substr(sha256(CASE WHEN len({keys}) = 0 THEN '[]' ELSE '[\"' || "
            f"array_to_string(list_transform({keys}, lambda k: {json_escape('k')}), '\", \"') || '\"]' END), 1, 16) "
            f"AS fingerprint FROM {src} GROUP BY day")

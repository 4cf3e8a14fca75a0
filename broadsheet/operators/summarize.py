"""Summaries: heuristic summary, LLM request rows, reply heading, TL;DR extract.

All pure Catalyst: sentences come from one ``regexp_extract_all`` whose
pattern yields already-stripped, non-empty sentences, so no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import JAVA_WS_CLASS, java_not, thousands, word_count, ws_strip

# a sentence: text between . ! ? separators, stripped, non-empty
SENTENCE_RE = java_not(".!?") + "(?:[^.!?]*" + java_not(".!?") + ")?"

# Summary limits and defaults.
TLDR_SENTENCES = 3
TLDR_MAX = 500
QUOTE_MIN = 50
MAX_INPUT_CHARS = 15000
TRUNCATION_MARK = "\n\n[Content truncated...]"
NO_CONTENT = "No content available."
NO_QUOTE = "*[No substantial quotes extracted]*"
UNTITLED_ARTICLE = "Untitled Article"
TLDR_DEFAULT = "Summary not available."

# The heuristic summary's Markdown skeleton (seven sections).
# The note and footer lines are written neutrally here.
MOCK_NOTE = "> **Note**: This is a heuristic summary generated without a language model."
MOCK_FOOTER = "*Generated by the heuristic summarizer*"
MOCK_SECTIONS = [
    ("Core Ideas/Methods", "*[Mock summary - detailed analysis requires LLM]*"),
    ("Key Evidence/Examples", "*[Mock summary - evidence extraction requires LLM]*"),
    ("Limitations/Open Questions", "*[Mock summary - critical analysis requires LLM]*"),
    ("Practical Implications", "*[Mock summary - practical takeaways require LLM analysis]*"),
]
PROBLEM_LINE = "*[Mock summary - content analysis not available without LLM]*"

# The summary request template ({text} is the article text).
SUMMARY_PROMPT = """You are a skilled research assistant. Your task is to summarize the following article accurately and comprehensively.

IMPORTANT RULES:
1. Only use information explicitly stated in the provided text.
2. Never add information not present in the original article.
3. If something is unclear or not mentioned, say so rather than guessing.
4. Preserve the author's key arguments and evidence faithfully.

Please structure your summary using the following sections:

## TL;DR
A 2-3 sentence executive summary capturing the main point.

## Problem/Motivation
What problem or question does this article address? Why does it matter?

## Core Ideas/Methods
What are the main concepts, approaches, or methods presented?

## Key Evidence/Examples
What evidence, data, or examples support the main arguments?

## Limitations/Open Questions
What limitations does the author acknowledge? What questions remain unanswered?

## Practical Implications
What are the practical takeaways or applications?

## Key Quotes
2-3 notable direct quotes from the article (with quotation marks).

---

ARTICLE TEXT:
{text}
"""

# text after "## TL;DR", optional whitespace and a newline, lazily up to the
# next "\n##", "\n---" or the end (the terminator is consumed, not captured)
TLDR_RE = "(?s)## TL;DR" + JAVA_WS_CLASS + "*\n(.+?)(?:\n##|\n---|\\z)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sentences(text) -> Column:
    """Stripped, non-empty sentences split on ``.``, ``!`` and ``?``."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(SENTENCE_RE), 0)


def summary_parts(text) -> dict[str, Column]:
    """F1 pieces: word/sentence counts, TL;DR (first 3 sentences, cut at 500), quote."""
    s = sentences(text)
    first = F.array_join(F.slice(s, 1, TLDR_SENTENCES), " ")
    tldr = (F.when(F.size(s) == 0, F.lit(NO_CONTENT))
            .when(F.length(first) > TLDR_MAX, F.concat(F.substring(first, 1, TLDR_MAX), F.lit("...")))
            .otherwise(first))
    long_one = F.try_element_at(F.filter(s, lambda x: F.length(x) > QUOTE_MIN), F.lit(1))
    quote = F.when(long_one.isNotNull(), F.concat(F.lit('"'), long_one, F.lit('"')))
    n_words = word_count(_c(text))
    return {"tldr": tldr, "quote": quote, "n_sentences": F.size(s), "n_words": n_words}


def mock_summary(text, title) -> Column:
    """the seven-section Markdown summary."""
    p = summary_parts(text)
    t = F.coalesce(F.nullif(_c(title), F.lit("")), F.lit(UNTITLED_ARTICLE))
    pieces = [
        F.lit("# Summary: "), t, F.lit("\n\n" + MOCK_NOTE + "\n\n## TL;DR\n"), p["tldr"],
        F.lit("\n\n## Problem/Motivation\n" + PROBLEM_LINE + "\n\nThis article contains approximately "),
        thousands(p["n_words"]), F.lit(" words and "), p["n_sentences"].cast("string"), F.lit(" sentences.\n\n"),
    ]
    for head, line in MOCK_SECTIONS:
        pieces.append(F.lit(f"## {head}\n{line}\n\n"))
    pieces += [F.lit("## Key Quotes\n"), F.coalesce(p["quote"], F.lit(NO_QUOTE)),
               F.lit("\n\n---\n" + MOCK_FOOTER + "\n")]
    return F.concat(*pieces)


def truncate_input(text, max_chars: int = MAX_INPUT_CHARS) -> Column:
    """text over ``max_chars`` is cut and marked."""
    t = _c(text)
    return F.when(F.length(t) > max_chars,
                  F.concat(F.substring(t, 1, max_chars), F.lit(TRUNCATION_MARK))).otherwise(t)


def summary_request(text, max_chars: int = MAX_INPUT_CHARS) -> Column:
    """the request prompt for one article (the request table's payload)."""
    head, tail = SUMMARY_PROMPT.split("{text}")
    return F.concat(F.lit(head), truncate_input(text, max_chars), F.lit(tail))


def with_title_heading(reply, title) -> Column:
    """prepend ``# Summary: {title}`` unless the reply starts with ``# {title}``."""
    r, t = F.coalesce(_c(reply), F.lit("")), _c(title)
    need = (F.coalesce(t, F.lit("")) != "") & ~r.startswith(F.concat(F.lit("# "), F.coalesce(t, F.lit(""))))
    return F.when(need, F.concat(F.lit("# Summary: "), t, F.lit("\n\n"), r)).otherwise(r)


def apply_replies(articles: DataFrame, replies: DataFrame, key: str = "url_hash") -> DataFrame:
    """``articles`` plus ``summary`` from a reply table ``(key, reply, error)``.

    Replies come from a service run outside the engine.  A row with an
    ``error`` failed: the article has no summary and carries ``summary_error``;
    an article without a reply row is still ``pending``.  Of several rows of a
    key one without error is preferred, then the smallest reply text.
    """
    best = replies.groupBy(key).agg(F.min(F.struct(F.col("error").isNotNull().alias("failed"), "reply", "error")).alias("_r"))
    j = articles.join(best, key, "left")
    ok = F.col("_r").isNotNull() & ~F.col("_r.failed")
    return (j.withColumn("summary", F.when(ok, with_title_heading(F.col("_r.reply"), F.col("title"))))
            .withColumn("summary_error", F.when(F.col("_r.failed"), F.concat(F.lit("Failed to generate summary: "), F.col("_r.error"))))
            .withColumn("pending", F.col("_r").isNull()).drop("_r"))


def tldr_section(summary_md) -> Column:
    """the TL;DR section's text, or ``Summary not available.``."""
    s = _c(summary_md)
    hit = F.coalesce(s.contains("## TL;DR"), F.lit(False)) & F.coalesce(s.rlike(TLDR_RE), F.lit(False))
    return F.when(hit, ws_strip(F.regexp_extract(s, TLDR_RE, 1))).otherwise(F.lit(TLDR_DEFAULT))

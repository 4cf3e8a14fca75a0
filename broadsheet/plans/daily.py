"""Daily Markdown digest as a distributed line table.

The digest of a day is emitted as ordered *lines* ``(day, part, k1, k2,
line_no, text)`` rather than one string: a day holding a third of all
articles is then still spread over many tasks, and the text sink writes
each day's lines range-partitioned in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.text import thousands
from broadsheet.operators.summarize import tldr_section

EMPTY_DAY = "No articles ingested on this date."


def daily_totals(articles: DataFrame) -> DataFrame:
    """Per fetch day, article count and total words."""
    return (articles.groupBy(F.to_date("fetched_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("articles"),
                 F.sum("word_count").cast("long").alias("total_words")))


def article_block(a: DataFrame) -> DataFrame:
    """One Markdown block per article (lines joined by newlines)."""
    tags = F.when(F.size(F.coalesce("tags", F.array())) > 0, F.array_join("tags", ", ")).otherwise(F.lit("none"))
    text = F.concat(
        F.lit("### "), F.col("title"), F.lit("\n\n- **URL**: ["), F.col("url"), F.lit("]("), F.col("url"),
        F.lit(")\n- **Words**: "), thousands(F.col("word_count")),
        F.lit("\n- **Source**: "), F.col("source"),
        F.lit("\n- **Tags**: "), tags,
        F.lit("\n\n**Summary**: "), tldr_section(F.col("summary")),
        F.lit("\n\n[Read full summary](library/"), F.col("stored_path"), F.lit("/summary.md)\n\n---\n"))
    return a.select(F.to_date("fetched_at").alias("day"), "fetched_at", "url_hash", text.alias("text"))


def digest_lines(articles: DataFrame, days: list[str] | None, generated_at: str) -> DataFrame:
    """Header, totals and article blocks for each requested day.

    ``days`` lists the requested dates (``YYYY-MM-DD``; a day without
    articles gets the empty-day line) or is None for every day that has
    articles.  Requested days are a literal filter, so no join routes a huge
    day into one task.  Order within a day: ``part`` (0 header, 1 articles),
    then fetch time, then url hash.
    """
    if days is not None:
        wanted = [F.lit(d).cast("date") for d in days]
        articles = articles.filter(F.to_date("fetched_at").isin(*wanted))
        spark = articles.sparkSession
        day_rows = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date").alias("day"))
    totals = daily_totals(articles)
    base = totals if days is None else day_rows.join(totals, "day", "left")
    head = (base
            .select("day", F.concat(
                F.lit("# Daily Reading Digest: "), F.date_format("day", "yyyy-MM-dd"),
                F.lit("\n\n*Generated: " + generated_at + "*\n\n"),
                F.when(F.col("articles").isNull(), F.lit(EMPTY_DAY + "\n"))
                .otherwise(F.concat(F.lit("## Summary\n\n- **Articles ingested**: "), F.col("articles").cast("string"),
                                    F.lit("\n- **Total words**: "), thousands(F.col("total_words")),
                                    F.lit("\n\n---\n\n## Articles\n")))).alias("text"))
            .select("day", F.lit(0).alias("part"), F.lit(None).cast("timestamp_ntz").alias("fetched_at"),
                    F.lit("").alias("url_hash"), "text"))
    body = article_block(articles).select("day", F.lit(1).alias("part"), "fetched_at", "url_hash", "text")
    return head.unionByName(body)


def write_digests(lines: DataFrame, path: str) -> None:
    """G2 sink: one folder per day; range-partitioned so files concatenate in order."""
    (lines.repartitionByRange("day", "part", "fetched_at", "url_hash")
     .sortWithinPartitions("day", "part", "fetched_at", "url_hash")
     .select(F.date_format("day", "yyyy-MM-dd").alias("d"), "text")
     .write.mode("overwrite").partitionBy("d").text(path))

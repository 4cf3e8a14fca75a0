"""Scans of the provided parquet tables and the stand-in article views built on them.

The engine's jobs take *article rows* (``title, url, source, date, content,
tags, fetched_at, ord``) and *raw pages* (``url, html, ord``).  The provided
``documents`` table has text but no URL/title/date, so ``article_view`` gives
each document those fields by a fixed rule (SURVEY 7.3).  That view only
shapes input rows; every job downstream works on any rows of that schema.
The same rule is written in SQL in ``broadsheet.plans.oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Fixed values of the stand-in rule: reference clock for freshness and the
# cut-off before which documents count as already ingested (seen history).
AS_OF = "2024-01-31 12:00:00"
HISTORY_BEFORE = "2024-01-17"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _host(doc_id: Column) -> Column:
    m = F.pmod(doc_id, F.lit(5))
    return (F.when(m == 0, "openai.com").when(m == 1, "arxiv.org").when(m == 2, "GitHub.com")
            .when(m == 3, "reddit.com:443").otherwise("blog.example.com"))


def article_view(documents: DataFrame) -> DataFrame:
    """Documents as article rows: ord, url, title, content, source, fetched_at, date, tags."""
    d = F.col("doc_id")
    url = F.concat(
        F.lit("https://"), _host(d), F.lit("/a/"),
        (d - F.when(F.pmod(d, F.lit(7)) == 6, F.lit(5)).otherwise(F.lit(0))).cast("string"),
        F.when(F.pmod(d, F.lit(3)) == 0, F.lit("/")).otherwise(F.lit("")),
        F.when(F.pmod(d, F.lit(4)) == 0, F.lit("?utm_source=x&id=1")).otherwise(F.lit("?id=1")))
    date = (F.when(F.pmod(d, F.lit(11)) == 0, F.lit(None).cast("string"))
            .when(F.pmod(d, F.lit(13)) == 0, F.lit("bad"))
            .otherwise(F.date_format(F.date_sub(F.lit("2024-01-31").cast("date"),
                                                F.pmod(d, F.lit(45)).cast("int")), "yyyy-MM-dd")))
    return documents.select(
        d.alias("ord"),
        url.alias("url"),
        F.substring(F.substring_index(F.col("text"), "\n", 1), 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.col("source"),
        # one article every ten minutes, so small tables fill several fetch days
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            secs=(d * 600).cast("decimal(18,6)"))).alias("fetched_at"),
        date.alias("date"),
        F.array(F.col("lang"), F.col("source")).alias("tags"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_view(read_table(spark, sf_dir, "documents"))


def history_split(art: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, batch): articles published before ``HISTORY_BEFORE`` were ingested earlier."""
    old = F.coalesce(F.col("date") < F.lit(HISTORY_BEFORE), F.lit(False))
    return art.filter(old), art.filter(~old)


def page_view(pages: DataFrame) -> DataFrame:
    """Raw pages as ``ord, url, html`` (A9: the fetch step's output table)."""
    return pages.select(F.col("page_id").alias("ord"), "url", "html")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_view(read_table(spark, sf_dir, "pages"))

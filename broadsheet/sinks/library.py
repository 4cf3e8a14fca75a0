"""Article library: rows, partitioned write, date scan, items projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.schemas import ARTICLE


def library_rows(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Article rows in the library layout (``year``/``month`` partition columns)."""
    return (df.withColumn("year", F.date_format("fetched_at", "yyyy"))
            .withColumn("month", F.date_format("fetched_at", "MM"))
            .select(*ARTICLE.fieldNames(), "stored_path", *extra))


def write_library(rows: DataFrame, path: str) -> None:
    """G1: append to the Parquet library partitioned by year/month.

    Rows go to tasks by partition and a hash of the row key, so a month of any
    size (an ingest usually fills one) is written by many tasks; AQE joins
    small ones.  ``url_hash`` is the row key, so two same-slug articles in one
    second never overwrite.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64("url_hash"), F.lit(n))
    (rows.repartition("year", "month", lane).sortWithinPartitions("year", "month", "fetched_at", "url_hash")
     .write.mode("append").partitionBy("year", "month").parquet(path))


def library_for_date(lib: DataFrame, day: str) -> DataFrame:
    """Articles fetched on ``day``; the year/month predicates prune partitions."""
    d = F.lit(day).cast("date")
    # partition discovery types year/month as int; in-memory rows carry "2024"/"01"
    return lib.filter((F.col("year").cast("int") == F.year(d))
                      & (F.col("month").cast("int") == F.month(d))
                      & (F.to_date("fetched_at") == d))


def library_items(lib: DataFrame) -> DataFrame:
    """Library rows as digest items (source := manual|rss, date := published or fetch day)."""
    return lib.select(
        "title", "url", F.col("source").alias("source"),
        F.coalesce(F.nullif(F.col("published_date"), F.lit("")),
                   F.date_format("fetched_at", "yyyy-MM-dd")).alias("date"),
        F.lit(None).cast("string").alias("snippet"),
        "content", "author", "tags", "fetched_at", "url_hash")

"""Seen-log records and their append sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seen_records(df: DataFrame, stored_path_col: str = "stored_path",
                 source_col: str = "source_type") -> DataFrame:
    """D10 (builder): one seen record per accepted article, plus its ``pos``.

    ``pos = (batch_id, ord)`` keeps the log's append order explicit, so
    "last record wins" never depends on file layout.
    """
    return df.select(
        F.struct(F.col("batch_id").cast("long").alias("batch"), F.col("ord").alias("ord")).alias("pos"),
        "url", "url_hash", "content_hash", "title", "fetched_at",
        F.col(stored_path_col).alias("stored_path"), F.col(source_col).alias("source"))


def append_seen(records: DataFrame, path: str) -> None:
    """D10 (sink): append to the seen table, clustered by ``url_hash`` within files."""
    (records.repartition("url_hash").sortWithinPartitions("url_hash")
     .write.mode("append").parquet(path))


def to_jsonl_lines(records: DataFrame) -> DataFrame:
    """Seen records as JSON lines (``value``) with their position, for JSONL interchange."""
    cols = [c for c in records.columns if c != "pos"]
    return records.select("pos", F.to_json(F.struct(*cols)).alias("value"))

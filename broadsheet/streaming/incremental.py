"""Incremental ingest on Structured Streaming.

New source-line files dropped into a folder are picked up as micro-batches;
each batch runs the batch ingest plan (I1) against the seen store written by
the batches before it, so running again over known sources skips what is
already seen.  A batch reads the store's buckets of its own keys only.

Exactly-once / replay safety: every sink (outcomes, library, seen store) is
partitioned by ``batch_id`` and written with dynamic partition overwrite, so
a batch replayed after a failure rewrites exactly its own partitions; the
records a batch reads exclude its own ``batch_id``.  The batch's commit in the
store comes last, and readers take committed batches only.  The stream
checkpoint lives in the shared checkpoint folder named by the session.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.plans.ingest import ingest_batch
from broadsheet.session import cut_lineage
from broadsheet.sinks.seen_store import BUCKETS, COMPACT_EVERY, SeenStore, read_state
from broadsheet.sources.feeds import expand_sources, source_lines

LINE_SCHEMA = T.StructType([T.StructField("pos", T.LongType()), T.StructField("value", T.StringType())])


def _overwrite_batch(df: DataFrame, path: str, parts: list[str]) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*parts).parquet(path))


def make_batch_writer(feeds: Callable[[], DataFrame], pages: Callable[[], DataFrame], out_dir: str, fetched_at: str,
                      compact_every: int = COMPACT_EVERY, buckets: int = BUCKETS):
    """foreachBatch body: ingest one batch of source lines, write its sinks and commit it.

    ``feeds`` and ``pages`` are called per batch, so files that arrived since
    the last one are listed.  The commit is the last write: readers see all of
    a batch or nothing.
    """
    outcomes_p, library_p, seen_p = (os.path.join(out_dir, n) for n in ("outcomes", "library", "seen"))

    def run(batch: DataFrame, batch_id: int) -> None:
        store = SeenStore(batch.sparkSession, seen_p, buckets)
        if len(store.state().batches) >= compact_every:
            store.compact()
        expanded = expand_sources(source_lines(batch.withColumn("pos", F.struct("file", "pos"))), feeds())
        res = ingest_batch(expanded, pages(), None, fetched_at, batch_id=batch_id, seen_lookup=lambda keys: store.lookup(keys, before=batch_id))
        # the accepted rows feed two sinks: materialised once
        res.articles, res.seen = cut_lineage(res.articles), cut_lineage(res.seen)
        _overwrite_batch(res.outcomes.withColumn("batch_id", F.lit(batch_id)), outcomes_p, ["batch_id"])
        _overwrite_batch(res.articles.withColumn("batch_id", F.lit(batch_id)), library_p,
                         ["year", "month", "batch_id"])
        store.put(res.seen, batch_id)
        store.commit(batch_id)

    return run


def start_incremental_ingest(spark: SparkSession, sources_glob: str, feeds: Callable[[], DataFrame],
                             pages: Callable[[], DataFrame], out_dir: str, checkpoint: str, fetched_at: str, available_now: bool = False,
                             interval: str = "10 seconds", buckets: int = BUCKETS):
    """Start J1: stream parquet drops of ``(pos, value)`` source lines.

    Each drop (a folder of part files matched by ``sources_glob``) that has
    arrived by a trigger forms the next micro-batch; ``available_now`` processes
    what is there and stops (a scheduled incremental run).  Lines are ordered
    by file, then by ``pos``; several files may share a micro-batch.
    """
    stream = spark.readStream.schema(LINE_SCHEMA).parquet(sources_glob).withColumn("file", F.col("_metadata.file_path"))
    w = (stream.writeStream.foreachBatch(make_batch_writer(feeds, pages, out_dir, fetched_at, buckets=buckets))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def _committed(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    state = read_state(spark, os.path.join(out_dir, "seen"))
    return spark.read.parquet(os.path.join(out_dir, table)).filter(state.committed(F.col("batch_id")))


def read_outcomes(spark: SparkSession, out_dir: str) -> DataFrame:
    """Outcomes of the committed batches."""
    return _committed(spark, out_dir, "outcomes")


def read_library(spark: SparkSession, out_dir: str) -> DataFrame:
    """Articles of the committed batches."""
    return _committed(spark, out_dir, "library")

"""Seen log as a bucketed store with commits.

Records lie in ``by_url``, partitioned by a bucket of ``url_hash``; a second
table ``by_content`` maps content hashes to URL hashes, partitioned by a bucket
of ``content_hash``.  A batch looks its own keys up: it reads the content
buckets of its contents, then the URL buckets of its URLs and of the URLs found,
and no other file, however long the log is.

Every batch writes partitions of its own (``batch_id``), and its last write is
one row in ``commits``.  Readers take committed batches only, so a batch killed
between two writes cannot be seen; when it runs again under the same id, it
overwrites what it left.  ``compact`` writes a new generation with one resolved
record per URL and makes it current by its commit; until then readers stay with
the old one.  Files of older generations are never read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import cut_lineage

BUCKETS = 64  # more for a log of billions: a bucket should stay a few files' worth
COMPACT_EVERY = 64  # batches of a generation
FIELDS = ("url", "content_hash", "title", "fetched_at", "stored_path", "source")


@dataclass(frozen=True)
class State:
    """Current generation, the last batch folded into it, and the batches committed since."""

    generation: int
    through: int
    batches: tuple[int, ...]

    def committed(self, batch_id: Column) -> Column:
        return (batch_id <= self.through) | batch_id.isin(list(self.batches))


def read_state(spark: SparkSession, path: str) -> State:
    """What is committed; a path that does not exist is an empty store, any other error is raised."""
    try:
        rows = spark.read.schema("kind string, batch_id long, generation int").parquet(f"{path}/commits").collect()  # one row a batch since the last compaction
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return State(0, -1, ())
    bases = [(r.generation, r.batch_id) for r in rows if r.kind == "base"]
    generation, through = max(bases, default=(0, -1))
    return State(generation, through, tuple(sorted({r.batch_id for r in rows if r.kind == "batch" and r.generation == generation})))


def _bucket(hash_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(hash_col), F.lit(buckets)).cast("int")


class SeenStore:
    """The store below ``path`` (in a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def state(self) -> State:
        return read_state(self.spark, self.path)

    def _write(self, rows: DataFrame, table: str, generation: int) -> None:
        """One file a bucket and batch: rows of a bucket meet in one task; buckets share the log evenly."""
        n = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        (rows.repartition(n, "bucket").sortWithinPartitions("batch_id", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "bucket").parquet(f"{self.path}/gen-{generation}/{table}"))

    def _commit(self, kind: str, batch_id: int, generation: int) -> None:
        row = self.spark.range(1).select(F.lit(kind).alias("kind"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(generation).alias("generation"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def put(self, records: DataFrame, batch_id: int) -> None:
        """Write a batch's records (``pos``, ``url_hash`` and ``FIELDS``); invisible until :meth:`commit`.  ``pos`` orders the whole log."""
        generation = self.state().generation
        rows = records.select("pos", F.col("pos").alias("first_pos"), "url_hash", *FIELDS, F.lit(batch_id).cast("long").alias("batch_id"))
        self._write(rows.withColumn("bucket", _bucket("url_hash", self.buckets)), "by_url", generation)
        self._write(rows.select("content_hash", "url_hash", "batch_id").distinct().withColumn("bucket", _bucket("content_hash", self.buckets)), "by_content", generation)

    def commit(self, batch_id: int) -> None:
        """Make the batch visible: the last write of a batch.  A batch that is already committed stays so."""
        state = self.state()
        if batch_id > state.through and batch_id not in state.batches:
            self._commit("batch", batch_id, state.generation)

    def _table(self, table: str, state: State, before: int | None) -> DataFrame | None:
        if state.through < 0 and not state.batches:
            return None
        rows = self.spark.read.parquet(f"{self.path}/gen-{state.generation}/{table}")
        rows = rows.filter(state.committed(F.col("batch_id")))
        return rows if before is None else rows.filter(F.col("batch_id") < before)

    @staticmethod
    def _resolved(records: DataFrame) -> DataFrame:
        """Last record per URL at its first position."""
        return records.groupBy("url_hash").agg(F.min("first_pos").alias("first_pos"), F.max("pos").alias("pos"),
                                               *[F.max_by(c, "pos").alias(c) for c in FIELDS])

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame | None:
        """Resolved records (A6) that ``keys`` (url_hash, content_hash) can collide with, from their buckets only.

        Those of the keys' URLs, and of every URL that ever carried one of their
        contents; None for an empty store.  ``before`` leaves out later batches.
        """
        state = self.state()
        contents, urls = self._table("by_content", state, before), self._table("by_url", state, before)
        if urls is None:
            return None
        wanted = keys.select("content_hash").filter("content_hash is not null").distinct()
        wanted = cut_lineage(self._in_buckets(contents, wanted, "content_hash").join(wanted, "content_hash", "left_semi").select("url_hash")
                  .unionByName(keys.select("url_hash")).filter("url_hash is not null").distinct())
        return cut_lineage(self._resolved(self._in_buckets(urls, wanted, "url_hash").join(wanted, "url_hash", "left_semi")))

    def _in_buckets(self, rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
        """The part of a table in the buckets that some keys fall into, given to the scan as at most ``buckets`` numbers."""
        found = keys.select(_bucket(col, self.buckets)).distinct().collect()
        return rows.filter(F.col("bucket").isin([r[0] for r in found]))

    def latest(self, before: int | None = None) -> DataFrame | None:
        """The whole resolved log (A6); None for an empty store."""
        urls = self._table("by_url", self.state(), before)
        return None if urls is None else self._resolved(urls)

    def compact(self) -> None:
        """Fold all committed batches into a new generation: one record per URL, and its content only."""
        state = self.state()
        if not state.batches:
            return
        through = max(state.batches)
        rows = self.latest().withColumn("batch_id", F.lit(through).cast("long"))
        self._write(rows.withColumn("bucket", _bucket("url_hash", self.buckets)), "by_url", state.generation + 1)
        self._write(rows.select("content_hash", "url_hash", "batch_id").withColumn("bucket", _bucket("content_hash", self.buckets)), "by_content", state.generation + 1)
        self._commit("base", through, state.generation + 1)

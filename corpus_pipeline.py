"""Corpus pipeline: quality rules, exact dedup, near-duplicate join, source mixing, segmentation.

``STAGES`` lists (name, function) in order; each function takes (spark, docs,
sf_dir) and returns the documents its successor works on.  ``run`` applies them
to the table ``documents``; every stage's result is written as Parquet in the
shared checkpoint folder and reread, so a lost executor never recomputes more
than one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import exact_dedup, mixing, ngram_join, quality_rules, segment
from broadsheet.session import ensure_checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v2 of the rule ledger."""
    return quality_rules.passing(docs, "v2")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by 5-gram Jaccard similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def segment_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with one sampled segmentation (``pieces``) and the text decoded from it."""
    out = segment.encode(docs, decoded=True)
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return out.withColumn("n_pieces", F.size("pieces")).withColumn("lossless", same)


STAGES = [("quality rules", keep_quality), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing", mix_sources), ("segmentation", segment_texts)]

# The near-duplicate, mixing and segmentation stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs

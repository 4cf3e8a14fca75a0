"""Thin registered queries ``op<N>_<name>``: one operator each, production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import exact_dedup, hard_negatives, language_id, merkle, mixing, ngram_join, packing, quality_classifier, quality_rules, segment, sharding, substring_dedup, warc
from broadsheet.llm.common import crc32_of_id


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without 13-word windows that an earlier document has."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=13)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-feature ridge scores of all documents; labels with crc32(doc_id) mod 5 = 0 are held out.

    Of the others, remainder 4 calibrates and 1 to 3 fit.
    """
    fold = crc32_of_id(F.col("doc_id")) % 5
    scored = quality_classifier.fit_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality",
                                              fit=fold.isin(1, 2, 3), calibrate=fold == 4)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM language of all documents, learned where crc32(doc_id) mod 3 is not 1."""
    fold = crc32_of_id(F.col("doc_id")) % 3
    out = language_id.identify(_table(spark, sf_dir, "documents"), learn=fold != 1)
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by 4-gram Jaccard similarity of 85 % or more."""
    return ngram_join.components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmask ledger of all documents under policy v2; measurements and failure bits kept."""
    rows = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), "v2")
    base = rows["fail_bits"].bitwiseAND(quality_rules.mask("base")) != 0
    return rows.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy-balanced mix of all documents to weights 5, 2, 1 at 150 % of the tokens, at most 2 copies."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew-safe exact dedup of all documents."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by byte ranges."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jump consistent hashing of all documents to 16 shards, and to 17."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)


def op10_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sampled segmentation of every document, decoded again."""
    return segment.round_trip(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents and every row's proof, held against texts that lost their newlines."""
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, every round with the sources' shares."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and its 5 positives, 10 negatives each from the score window; every seventh id's label is one further."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_classifier, op3_language_id, op4_ngram_join, op5_quality_rules, op6_mixing, op7_exact_dedup, op8_warc,
                                   op9_sharding, op10_segmentation, op11_merkle_manifest, op12_packing,
                                   op13_hard_negatives)}

"""Exact deduplication by skew-safe combining.

Equal texts (after lower-casing A-Z only) form a group; the row with the
largest id stays.  Groups are built in three steps, each of which groups by
the digest AND the whole text, so a digest collision never merges texts:
rows of one task first (partial aggregation before the exchange), then the
rows of one salt, then the winners of all salts.  A content that holds a third
of all rows so reaches the last step as at most ``SALTS`` rows.

Winners are joined back by digest.  Digests that more than one content shares
(none for SHA-256) are resolved by the whole text in a second join.

Defined cases: a null text counts as empty; a null id loses against any id
(a group of null ids only keeps one of its rows); of rows that repeat id and
text one is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import ascii_lower, lookup
from broadsheet.session import cut_lineage

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, text, keep_id, group_size) per distinct text of rows (digest, text, id)."""
    top = lambda df, n, *by: df.groupBy("digest", *by, "norm").agg(F.max("keep_id").alias("keep_id"), F.sum(n).alias("group_size"))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("one", F.lit(1).cast("long"))
    return top(top(salted, "one", "salt"), "group_size")


def _tagged(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """rows plus norm and digest."""
    norm = rows.withColumn("norm", ascii_lower(F.coalesce(F.col("text"), F.lit(""))))
    return norm.withColumn("digest", digest(F.col("norm")))


def winners(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, text_sha256) per row of (doc_id, text)."""
    tagged = _tagged(rows.select("doc_id", "text"), digest)
    found = _groups(tagged.select("digest", "norm", F.col("doc_id").alias("keep_id"))).drop("norm")
    found = cut_lineage(found)  # narrow: no text
    shared = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    narrow = tagged.select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"))
    if shared.isEmpty():
        return lookup(narrow, found, "digest", "group_size", F.xxhash64("doc_id"))
    alone = lookup(narrow.join(shared, "digest", "left_anti"), found.join(shared, "digest", "left_anti"), "digest",
                   "group_size", F.xxhash64("doc_id"))
    mixed = tagged.join(shared, "digest", "left_semi")
    mixed_groups = _groups(mixed.select("digest", "norm", F.col("doc_id").alias("keep_id")))
    exact = (mixed.join(mixed_groups, ["digest", "norm"])
             .select("doc_id", "digest", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    return alone.select(exact.columns).unionByName(exact)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row of ``docs``, dropped rows too."""
    out = winners(docs, digest)
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    cols = ["doc_id", "keep_id", "group_size", "text_sha256"]
    again = _repeated_ids(docs)
    if again.isEmpty():
        flagged = out.select(*cols, top.alias("kept"))
    else:
        # rows that repeat an id: equal rows are counted (with partial sums) and written anew, the first as the kept one
        one = out.join(again, out["doc_id"].eqNullSafe(again["again"]), "left_anti").select(*cols, top.alias("kept"))
        many = out.join(again, out["doc_id"].eqNullSafe(again["again"]), "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        many = many.select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i")).select(*cols, (top & (F.col("i") == 1)).alias("kept"))
        flagged = one.unionByName(many)
    return flagged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _repeated_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.col("doc_id").alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns (one per distinct normalised text)."""
    packed = docs.select(F.col("doc_id").alias("__id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    keep = winners(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest").distinct()
    again = _repeated_ids(docs)
    tagged = _tagged(packed, sha256).drop("norm", "text")
    join = lambda rows: rows.join(keep, rows["__id"].eqNullSafe(keep["doc_id"]) & (rows["digest"] == keep["digest"]), "left_semi")
    if again.isEmpty():
        return join(tagged).select("__doc.*")
    one = join(tagged.join(again, tagged["__id"].eqNullSafe(again["again"]), "left_anti"))
    many = join(tagged.join(again, tagged["__id"].eqNullSafe(again["again"]), "left_semi")).dropDuplicates(["__id", "digest"])
    return one.unionByName(many).select("__doc.*")

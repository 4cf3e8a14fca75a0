"""Sharding by jump consistent hashing.

A key's shard is found by a pseudo-random walk over shard counts: from bucket
b the next bucket is floor((b + 1) * 2^31 / (top 31 bits of the state + 1)),
until it passes the number of shards.  No ring table is kept, and one more
shard takes only the rows that move into it.

Slots number the rows of a shard from 0 without gaps.  A shard is cut into
hash buckets, so numbering never sorts a shard in one task: the bucket sizes
(shards * ``BUCKETS`` rows at most) are cumulated and broadcast.

Defined cases: a null id has the key 0; null texts have size 1 and the crc32
of an empty text; rows that repeat an id share its shard and get slots of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from broadsheet.session import cut_lineage

BUCKETS = 256
# Constants of the published algorithm (64-bit linear congruential step, 31 bits used).
STEP = 2862933555777941757
MOD = 1 << 64


def jump(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of an integer key (its 64-bit two's complement).

    The walk strictly ascends, so ``shards`` steps always suffice.  The state is
    a DECIMAL(20): its product with STEP has at most 38 digits and is exact.
    """
    dec = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    k = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
                     F.when(k < 0, (k + dec(MOD)).cast("decimal(20,0)")).otherwise(k).alias("k"))

    def step(a: Column, _: Column) -> Column:
        state = ((a["k"] * F.lit(str(STEP)).cast("decimal(19,0)") + F.lit(1)) % dec(MOD)).cast("decimal(20,0)")
        top = F.floor(state / dec(1 << 33)).cast("long")
        nxt = F.struct(a["j"].alias("b"), F.floor((a["j"] + 1) * (F.lit(float(1 << 31)) / (top + 1).cast("double"))).cast("long").alias("j"),
                       state.alias("k"))
        return F.when(a["j"] < shards, nxt).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda a: a["b"].cast("int"))


def numbered(rows: DataFrame, shard: str, spread: Column, order: list[Column]) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard, ordered by bucket and ``order``."""
    rows = cut_lineage(rows.withColumn("__b", F.pmod(spread, F.lit(BUCKETS)).cast("int")))
    sizes = rows.groupBy(shard, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn("__off", F.sum("__n").over(W.partitionBy(shard).orderBy("__b")) - F.col("__n")).drop("__n")
    local = F.row_number().over(W.partitionBy(shard, "__b").orderBy(*order)) - 1
    return (rows.withColumn("__local", local).join(F.broadcast(offsets), [shard, "__b"])
            .withColumn("slot", (F.col("__off") + F.col("__local")).cast("long")).drop("__b", "__off", "__local"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t).alias("text_crc32"),
                       F.lit("key").alias("law"), jump(F.col("doc_id"), shards).alias("shard"),
                       jump(F.col("doc_id"), shards + 1).alias("grown_shard"))
    spread = F.col("text_crc32") + F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(BUCKETS))
    out = numbered(rows, "shard", spread, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

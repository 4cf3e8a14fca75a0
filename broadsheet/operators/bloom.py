"""Bitmaps of wanted keys, to drop rows at their scan.

A blocked Bloom filter as a table: each key falls into one bucket of 32768
bits and sets ``BITS`` of them (``bitmap_construct_agg``), so a bucket is one
row of 4 KB and a lookup is one broadcast join with bit tests.  The table is
sized by the number of keys, ``BITS_PER_KEY`` each, up to ``MAX_BUCKETS``
(256 MB).  Rows of a wanted key always pass; of the others about 0.3 % do up to
130 million keys, and more beyond (37 % at 500 million).  Rows that pass still
have to be matched exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 32768
BITS = 4
BITS_PER_KEY = 16
MAX_BUCKETS = 1 << 16


def buckets_for(n_keys: int) -> int:
    """Number of buckets (a power of two) for so many keys."""
    need = max(1, -(-n_keys * BITS_PER_KEY // BUCKET_BITS))
    return min(MAX_BUCKETS, 1 << (need - 1).bit_length())


def _bucket(cols: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets))


def _places(cols: list[str]) -> list[Column]:
    h = F.xxhash64(*cols, F.lit(1))
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(BUCKET_BITS - 1)) for i in range(BITS)]


def key_bitmaps(keys: DataFrame, cols: list[str], buckets: int) -> DataFrame:
    """(``_bucket``, ``_bitmap``): one row per bucket that holds a key."""
    places = keys.select(_bucket(cols, buckets).alias("_bucket"), F.explode(F.array(*_places(cols))).alias("_place"))
    return places.groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bitmap"))


def may_hold(rows: DataFrame, bitmaps: DataFrame, cols: list[str], buckets: int) -> DataFrame:
    """The rows whose key may be one of the bitmaps' keys; no row is shuffled."""
    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1

    hit = F.lit(True)
    for place in _places(cols):
        hit = hit & is_set(place)
    return (rows.withColumn("_bucket", _bucket(cols, buckets)).join(F.broadcast(bitmaps), "_bucket")
            .filter(hit).select(*rows.columns))

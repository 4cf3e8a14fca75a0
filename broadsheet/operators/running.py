"""Running aggregates over large groups, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.session import cut_lineage


def running_before(rows: DataFrame, key: str, order: Column, value: str, agg: Callable[[Column], Column],
                   merge: Callable[..., Column], out: str) -> DataFrame:
    """``rows`` plus ``out``: ``agg`` of ``value`` over the rows of the same key strictly before each row.

    ``agg`` is a minimum or maximum and ``merge`` its scalar form (``F.least``,
    ``F.greatest``).  Rows are dealt by ranges of (key, order), so a key that
    fills the table lies in several tasks; each task runs over its own part,
    and what a key's earlier parts hold (one row a part and key) is merged in.
    The ranges are checkpointed: both steps see the same ones.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(rows.repartitionByRange(n, F.col(key), order).withColumn("_part", F.spark_partition_id()))
    earlier = (Window.unboundedPreceding, -1)
    per = parts.groupBy(key, "_part").agg(agg(F.col(value)).alias("_v"))
    carry = per.select(F.col(key).alias("_key"), F.col("_part").alias("_of"),
                       agg(F.col("_v")).over(Window.partitionBy(key).orderBy("_part").rowsBetween(*earlier)).alias("_carry"))
    local = agg(F.col(value)).over(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(*earlier))
    joined = parts.withColumn("_local", local).join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return joined.select(*rows.columns, merge("_carry", "_local").alias(out))

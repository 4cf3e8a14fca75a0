"""Column and DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import cut_lineage

# The word class of all contracts: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

# A group holding at least 1/HOT_SHARE of all rows is hot; at most HOT_SHARE groups can be.
HOT_SHARE = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column used inside a lambda may be inlined there and evaluated per
    element; a one-element ``transform`` binds it to a variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Word count of a text as a long; null and blank texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII texts take the vectorised ``lower``."""
    az = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, az, az.lower()))


def crc32_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, stats: DataFrame, key: str, size: str, spread: Column, total: int | None = None) -> DataFrame:
    """``rows LEFT JOIN stats ON key`` that survives hot keys.

    ``stats`` has one row per key; ``size`` is the number of rows of the key,
    so at most ``HOT_SHARE`` keys hold ``1/HOT_SHARE`` of all rows or more.
    Only those are broadcast.  Rows they match leave the shuffle join by a
    second key column that spreads them (``spread``: any integer per row) over
    all tasks.  Null keys match nothing and are spread the same way.
    ``total`` may give the number of rows, or more, if the caller knows it;
    else ``stats`` is summed, and should be a checkpointed table.
    """
    if total is None:
        total = stats.agg(F.sum(size)).first()[0] or 0
    others = [c for c in stats.columns if c != key]
    packed = stats.select(F.col(key).alias("__key"), F.struct(*others).alias("__stat"), F.col(size).alias("__size"))
    hot = F.broadcast(packed.filter(F.col("__size") * HOT_SHARE >= F.lit(total)).select("__key", F.col("__stat").alias("__hot")))
    cold = packed.filter(F.col("__size") * HOT_SHARE < F.lit(total)).select("__key", "__stat", F.lit(0).alias("__lane"))
    lane = F.when(F.col("__hot").isNotNull() | F.col(key).isNull(), 1 + F.pmod(spread, F.lit(4096)).cast("int")).otherwise(0)
    marked = rows.join(hot, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("__l", lane)
    out = marked.join(cold, (F.col(key) == F.col("__key")) & (F.col("__l") == F.col("__lane")), "left")
    out = out.withColumn("__s", F.coalesce("__hot", "__stat"))
    keep = [F.col(c) for c in rows.columns]
    return out.select(*keep, *[F.col("__s").getField(c).alias(c) for c in others])


# Id tables up to this many rows may be broadcast (a few dozen megabytes).
BROADCAST_IDS = 1_000_000


def small(ids: DataFrame) -> DataFrame | None:
    """``ids`` (a checkpointed table of one id column) marked for broadcast if it has few rows, else None."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else None


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Global 0-based rank by ``order`` without a one-task window.

    Range partitions are ranked locally; the sizes of the partitions (one row
    each) give the offsets.  The ranged rows are checkpointed, so both steps
    see the same ranges.
    """
    from pyspark.sql import Window as W

    n = partitions(df.sparkSession)
    parts = cut_lineage(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()))
    offsets = (parts.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__off", F.sum("__n").over(W.orderBy("__pid")) - F.col("__n")).drop("__n"))
    local = F.row_number().over(W.partitionBy("__pid").orderBy(*order)) - 1
    return (parts.withColumn("__local", local).join(F.broadcast(offsets), "__pid")
            .withColumn(out, (F.col("__off") + F.col("__local")).cast("long")).drop("__pid", "__off", "__local"))


CONTRACT = 200_000


def _stars(parts: list) -> dict[int, int]:
    """Smallest id of its piece per node of some edges (lists a, b); nodes that are their piece's smallest are left out."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for a, b in parts:
        for x, y in zip(a, b):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    return {x: r for x in up if (r := find(x)) != x}


def connected(edges: DataFrame, contract: int = CONTRACT) -> DataFrame:
    """(node, root) of the undirected edges (u, v) of long ids: root is the smallest id reachable.

    Tasks replace the edges they hold, ``contract`` at a time, by stars of the
    same pieces; a graph of up to ``contract`` edges is done after that.  Larger
    ones alternate this with large and small stars over all edges until nothing
    changes (a logarithmic number of rounds).  A node of very many edges is met
    by ``lookup``, so no task gets all of them.  Nodes without edges to others
    are not returned.
    """
    def contracted(batches):
        import pyarrow as pa

        def out(held):
            stars = _stars(held)
            return pa.RecordBatch.from_pydict({"a": pa.array(list(stars), pa.int64()), "b": pa.array(list(stars.values()), pa.int64())})

        held, n = [], 0
        for batch in batches:
            held.append((batch.column("a").to_pylist(), batch.column("b").to_pylist()))
            n += batch.num_rows
            if n >= contract:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    def rooted(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
            e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    e = cut_lineage(e)
    state = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            return rooted(e)
        state, tasks = mark, -(-mark[0] // contract)
        e = e.coalesce(tasks).mapInArrow(contracted, "a long, b long")
        if tasks == 1:
            return rooted(cut_lineage(e))
        e = cut_lineage(e.distinct())
        # large star: neighbours above a node move to its smallest neighbour (or itself)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both.filter("b > a"), least, "a", "n", F.col("b"), 2 * mark[0]).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: a node and its neighbours below move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        below = lookup(large, least, "a", "n", F.col("b"), mark[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(below.unionByName(least.select("a", F.col("m").alias("b"))).distinct())

"""Scoring and ranking: source authority, freshness, length, pre-rank top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from broadsheet.functions.dates import freshness_score, parse_loose_date
from broadsheet.session import cut_lineage

# Source-authority table, in priority order (first key found in
# the lower-cased source or URL wins; unknown sources weigh 2).
SOURCE_WEIGHTS = [
    ("openai", 5), ("anthropic", 5), ("google", 5), ("deepmind", 5), ("meta", 5),
    ("microsoft", 4), ("nvidia", 4), ("arxiv", 4), ("huggingface", 4),
    ("stability", 4), ("mistral", 4), ("cohere", 4),
    ("together", 3), ("github", 3), ("techcrunch", 3), ("theverge", 3),
    ("venturebeat", 3),
    ("hacker news", 2), ("reddit", 2),
]
DEFAULT_WEIGHT = 2

# The score mix.
W_SOURCE, W_FRESH, W_LENGTH = 0.4, 0.3, 0.3


def source_weight(source: Column, url: Column, rules=SOURCE_WEIGHTS) -> Column:
    """Weight of the first rule whose key is a substring of source or URL.

    Compiled to one CASE WHEN chain (codegen, no join); rule order matters.
    """
    src = F.lower(F.coalesce(source, F.lit("")))
    u = F.lower(url)
    expr = None
    for key, w in rules:
        cond = src.contains(key) | u.contains(key)
        expr = F.when(cond, F.lit(w)) if expr is None else expr.when(cond, F.lit(w))
    return expr.otherwise(F.lit(DEFAULT_WEIGHT)).cast("int")


def length_score(content: Column, snippet: Column | None = None) -> Column:
    """Length of content, else snippet, else '' mapped to 1..5."""
    parts = [F.nullif(content, F.lit(""))]
    if snippet is not None:
        parts.append(F.nullif(snippet, F.lit("")))
    n = F.length(F.coalesce(*parts, F.lit("")))
    return (F.when(n > 5000, F.lit(5.0)).when(n > 2000, F.lit(4.0)).when(n > 500, F.lit(3.0))
            .when(n > 100, F.lit(2.0)).otherwise(F.lit(1.0)))


def with_scores(items: DataFrame, as_of: str, snippet_col: str | None = None) -> DataFrame:
    """C1-C3 and the combined double score ``0.4*w + 0.3*f + 0.3*l`` (that order)."""
    snippet = F.col(snippet_col) if snippet_col else None
    return (items
            .withColumn("source_weight", source_weight(F.col("source"), F.col("url")))
            .withColumn("freshness", freshness_score(F.col("date"), F.lit(as_of).cast("timestamp_ntz")))
            .withColumn("length_score", length_score(F.col("content"), snippet))
            .withColumn("score", F.lit(W_SOURCE) * F.col("source_weight")
                        + F.lit(W_FRESH) * F.col("freshness")
                        + F.lit(W_LENGTH) * F.col("length_score")))


def pre_rank(items: DataFrame, as_of: str, top_k: int = 30, snippet_col: str | None = None) -> DataFrame:
    """Top ``k`` by score desc, input position asc, with a 1-based ``rank``.

    ``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task keeps
    its own top k and only k rows per task reach the final merge, so the
    full table is never sorted or shuffled.
    """
    scored = with_scores(items, as_of, snippet_col)
    top = scored.orderBy(F.col("score").desc(), F.col("ord").asc()).limit(top_k)
    # the rank is assigned over the k survivors only (a k-row window)
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("score").desc(), F.col("ord").asc())))


def rolling_window(items: DataFrame, day: str, days: int = 7) -> DataFrame:
    """Keep items dated in ``[day - (days-1), day]``; undated items are dropped."""
    d = F.to_date(parse_loose_date(F.col("date")))
    end = F.lit(day).cast("date")
    return items.filter(d.between(F.date_sub(end, days - 1), end))


def position_within(df: DataFrame, group: str, order: list[str], out: str = "position") -> DataFrame:
    """1-based position of each row in its group by ``order``, without sorting a group in one task.

    Rows are dealt by ranges of (group, order), so a large group lies in
    several tasks; each ranks its own part, and the sizes of a group's earlier
    parts (one row a task and group) are added.  The ranges are checkpointed:
    both steps see the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut_lineage(df.repartitionByRange(n, group, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.struct(group, "_part").alias("_key"), (F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    ranked = parts.withColumn("_local", local).withColumn("_key", F.struct(group, "_part"))
    out_col = (F.col("_before") + F.col("_local")).cast("long").alias(out)
    return ranked.join(before, ranked["_key"].eqNullSafe(before["_key"])).select(*df.columns, out_col)

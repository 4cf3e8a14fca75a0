"""Queries over digest documents: story search, hint search, tag filter, facets,
numbered report rows (H1-H5).

They run on the flat child tables of many digests at once (``group`` names the
digest); search terms are a short literal list matched per row, tags a small
broadcast table joined by equality, so one pass answers every digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# up to this many terms travel in the plan as a literal; more go through a term table
LITERAL_TERMS = 1000


def _with_terms(rows: DataFrame, terms: list[str], hit) -> DataFrame:
    """``rows`` once per matching term (column ``term``); ``hit(q)`` tests a trimmed, lower-cased term.

    Terms are user queries.  A short list is an array literal filtered per
    row; a longer one is a one-row table joined by a constant, so neither the
    plan nor the number of terms is bounded.
    """
    qs = [{"term": t, "q": t.strip().lower()} for t in terms if t.strip()]
    if not qs:
        return rows.withColumn("term", F.lit("")).filter(F.lit(False))
    if len(qs) <= LITERAL_TERMS:
        rows = rows.withColumn("_terms", F.array(*[F.struct(*[F.lit(x[k]).alias(k) for k in ("term", "q")]) for x in qs]))
    else:
        table = rows.sparkSession.createDataFrame([(0, qs)], "_k int, _terms array<struct<term:string,q:string>>")
        rows = rows.withColumn("_k", F.lit(0)).join(F.broadcast(table), "_k").drop("_k")
    found = F.explode(F.filter("_terms", lambda t: hit(t["q"])))
    return rows.withColumn("_t", found).withColumn("term", F.col("_t.term")).drop("_t", "_terms")


def story_search(cards: DataFrame, terms: list[str], group: str) -> DataFrame:
    """H1: stories whose title, one-liner, any tag, subtitle or source contains the term."""
    def has(c, q):
        return F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))

    def hit(q):
        return (has("title", q) | has("one_liner", q)
                | F.exists(F.coalesce("tags", F.array()), lambda x: F.lower(x).contains(q))
                | has("subtitle", q) | has("source", q))
    return _with_terms(cards, terms, hit).select(group, "term", "rank", "id")


def hint_search(hints: DataFrame, terms: list[str], group: str) -> DataFrame:
    """H2: search hints whose query hint or a matching tag contains the term,
    with their referenced story ids exploded."""
    def hit(q):
        return (F.coalesce(F.lower("query_hint").contains(q), F.lit(False))
                | F.exists(F.coalesce("matching_tags", F.array()), lambda x: F.lower(x).contains(q)))
    return (_with_terms(hints, terms, hit)
            .select(group, "term", "query_hint", F.explode_outer("top_refs").alias("ref_id")))


def tag_filter(cards: DataFrame, index: DataFrame, tags: list[str], group: str,
               section_items: DataFrame | None = None) -> DataFrame:
    """H3: stories and section items allowed by a tag: ``all`` keeps everything, a
    known tag keeps those whose id is listed under it in the digest's tag index,
    an unknown tag nothing.  Output: one row per (row, requested tag); ``kind``
    says ``story`` or ``section``, ``place`` the rank or the section's name."""
    rows = cards.select(group, F.lit("story").alias("kind"), F.col("rank").cast("string").alias("place"), "id")
    if section_items is not None:
        rows = rows.unionByName(section_items.select(group, F.lit("section").alias("kind"), F.col("name").alias("place"), "id"))
    wanted = rows.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tags) if t != "all"], "tag string")
    idx = index.join(wanted, "tag", "left_semi").select(group, "tag", "id").distinct()
    out = rows.withColumn("tag", F.lit("all")).filter(F.lit("all" in tags))
    return out.unionByName(rows.join(idx, [group, "id"]).select(group, "kind", "place", "id", "tag"))


def tag_facets(index: DataFrame, group: str) -> DataFrame:
    """H4: the digest's tag list, sorted, with its position."""
    tags = index.select(group, "tag").distinct()
    return tags.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("tag")))


def section_facets(section_items: DataFrame, group: str) -> DataFrame:
    """H4: number of items per section."""
    return section_items.groupBy(group, "name").agg(F.count(F.lit(1)).alias("items"))


def report_rows(cards: DataFrame, group: str) -> DataFrame:
    """H5: 1-based report numbering of stories in rank order."""
    w = Window.partitionBy(group).orderBy("rank")
    return cards.select(group, F.row_number().over(w).alias("n"), "id", "title")

"""Dedup against history and within a batch.

Keys are ``url_hash`` (canonical URL) and ``content_hash`` (canonical text).
Order is always an explicit ``ord`` column, never a generated id after a
shuffle.

Scale notes
-----------
* Every per-key step is a ``groupBy(key).agg(min/max_by, count)`` (partial
  aggregation: a key holding a third of all rows collapses map-side to one
  row per task) followed by a join back on the key.  No window sorts a whole
  key group in one task.  The join-back broadcasts the statistics of hot
  keys (bounded set, ``skew.lookup_join``) and shuffles the rest, so a hot
  key never lands in one join task either.
* Text never travels through these shuffles: callers pass ``(ord, url_hash,
  content_hash)`` only and join their wide columns back by ``ord``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.operators.running import running_before
from broadsheet.operators.skew import lookup_join
from broadsheet.schemas import SEEN
from broadsheet.session import cut_lineage



# ------------------------------------------------------------------ A6 / D5

def parse_seen_lines(lines: DataFrame, line_col: str = "value", pos_col: str = "pos") -> DataFrame:
    """A6 (parse): JSON lines -> valid seen records with their log position.

    Blank lines are skipped; lines that are not JSON objects or miss a
    required field (or carry a source other than manual/rss) are dropped.
    """
    parsed = (lines
              .filter(F.trim(F.col(line_col)) != "")
              .select(F.col(pos_col).alias("pos"),
                      F.from_json(F.col(line_col), SEEN, {"mode": "PERMISSIVE"}).alias("r")))
    valid = F.col("r").isNotNull()
    for f in SEEN.fieldNames():
        valid = valid & F.col(f"r.{f}").isNotNull()
    valid = valid & F.col("r.source").isin("manual", "rss")
    return parsed.filter(valid).select("pos", "r.*")


def read_seen_jsonl(spark, path: str) -> DataFrame:
    """A6 (scan): read a JSONL seen log with each line's position.

    Log files sort by name in append order.  A missing path yields an empty
    log; any other read error is raised.
    """
    try:
        raw = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("pos", T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.LongType())]))] + SEEN.fields))
    # position = (file, id assigned at the scan): orderable, no global sort,
    # and splits of one file keep their offset order
    lines = raw.select(F.struct(F.input_file_name().alias("file"),
                                F.monotonically_increasing_id().alias("line")).alias("pos"), "value")
    return parse_seen_lines(lines)


def seen_latest(records: DataFrame) -> DataFrame:
    """A6 (resolve): last record per ``url_hash`` wins, at its first position.

    ``first_pos`` orders the resolved log the way the reference's dict does
    (insertion order of the key, value of the latest write).
    """
    cols = [c for c in records.columns if c not in ("pos", "url_hash")]
    # one max_by per field (positions are unique per key, so all fields come
    # from the same record) lets Catalyst prune the fields a caller never reads
    return (records.groupBy("url_hash")
            .agg(F.min("pos").alias("first_pos"),
                 *[F.max_by(F.col(c), F.col("pos")).alias(c) for c in cols]))


def seen_latest_for(records: DataFrame, batch: DataFrame) -> DataFrame:
    """A6 restricted to what a batch can collide with (exact for D6/D7).

    A URL's latest record matters to a batch only if the URL is in the batch,
    or if one of the URL's records carries a content hash of the batch (its
    latest record may then be a content match).  Both selections are
    semi-joins on hash keys, so the per-URL resolution runs over the batch's
    neighbourhood instead of the whole, ever-growing log.
    """
    urls = batch.select("url_hash").distinct()
    by_content = records.join(batch.select("content_hash").distinct(), "content_hash", "left_semi")
    keys = urls.unionByName(by_content.select("url_hash")).distinct()
    return seen_latest(records.join(keys, "url_hash", "left_semi"))


def seen_content_hashes(latest: DataFrame) -> DataFrame:
    """Distinct content hashes of the latest records."""
    return latest.select("content_hash").distinct()


# ------------------------------------------------------------------ D6 / D7

def _has_content(df: DataFrame, content_col: str):
    """Content present: a boolean flag column as is, or a non-empty text column."""
    if isinstance(df.schema[content_col].dataType, T.BooleanType):
        return F.coalesce(F.col(content_col), F.lit(False))
    return F.coalesce(F.col(content_col), F.lit("")) != ""


def _content_matches(batch: DataFrame, latest: DataFrame, has_content, forced: DataFrame | None) -> DataFrame:
    """Narrow rows (content_hash, content_title, n): the batch's contents that history has.

    One row per content hash of the batch, with the number of batch rows that
    carry it, so a content that fills the batch is met once by the history.
    With ``forced`` also ``content_end``, the order at which the last record
    that holds the content is overwritten: (true, null) if one never is.
    """
    wanted = batch.filter(has_content).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    found = latest.join(wanted, "content_hash")
    aggs = [F.min_by("title", "first_pos").alias("content_title"), F.first("n").alias("n")]
    if forced is not None:
        found = found.join(forced.groupBy("url_hash").agg(F.min("ord").alias("end")), "url_hash", "left")
        aggs.append(F.max(F.struct(F.col("end").isNull().alias("never"), "end")).alias("content_end"))
    return found.groupBy("content_hash").agg(*aggs)


def _with_matches(batch: DataFrame, latest: DataFrame, content_col: str, forced: DataFrame | None = None) -> DataFrame:
    """``batch`` plus ``url_title`` and ``content_title``: titles of the history records it collides with.

    Both joins split hot keys: a content hash or URL repeated in the batch is
    looked up from broadcast statistics (see ``skew.lookup_join``).  The
    matches are narrow (the batch's own keys) and materialised, since each is
    read for its hot and its other keys.
    """
    has_content = _has_content(batch, content_col)
    urls = batch.groupBy("url_hash").agg(F.count(F.lit(1)).alias("n"))
    by_url = cut_lineage(latest.select("url_hash", F.struct("title").alias("url_seen")).join(urls, "url_hash"))
    matches = _content_matches(batch, latest, has_content, forced)
    seen = [c for c in matches.columns if c not in ("content_hash", "n")]
    by_content = cut_lineage(matches.select("content_hash", F.struct(*seen).alias("content_seen"), "n"))
    total = batch.count()
    j = lookup_join(batch, by_url, "url_hash", "n", "left", total=total)
    j = lookup_join(j, by_content, "content_hash", "n", "left", total=total)
    return j.withColumn("content_seen", F.when(has_content, F.col("content_seen")))


def duplicate_lookup(batch: DataFrame, latest: DataFrame, content_col: str = "content") -> DataFrame:
    """Per batch row ``is_dup`` and ``reason`` against history.

    URL match first (``URL already seen: {title}``), then, if the row has
    content, a content match (``Content matches existing: {title}`` of the
    first matching record).
    """
    j = _with_matches(batch, latest, content_col)
    reason = (F.when(F.col("url_seen.title").isNotNull(), F.concat(F.lit("URL already seen: "), F.col("url_seen.title")))
              .when(F.col("content_seen.content_title").isNotNull(),
                    F.concat(F.lit("Content matches existing: "), F.col("content_seen.content_title"))))
    return (j.withColumn("reason", reason)
            .withColumn("is_dup", F.col("reason").isNotNull())
            .drop("url_seen", "content_seen"))


def drop_seen(batch: DataFrame, latest: DataFrame, content_col: str = "content", forced: DataFrame | None = None) -> DataFrame:
    """Rows whose URL and (non-empty) content are both unseen (one pass, hot keys split).

    ``forced`` (url_hash, ord): rows admitted in the same run by force.  From
    their place on, the record of their URL is another one, and its old content
    is forgotten unless a record of another URL holds it.
    """
    j = _with_matches(batch, latest, content_col, forced)
    held = F.col("content_seen").isNotNull()
    if forced is not None:
        end = F.col("content_seen.content_end")
        held = held & (end["never"] | (end["end"] > F.col("ord")))
    return j.filter(F.col("url_seen").isNull() & ~held).drop("url_seen", "content_seen")


# ---------------------------------------------------------------------- D8

def _group_sizes(undecided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per url hash and per recorded content hash: first ord and group size."""
    su = undecided.groupBy("u").agg(F.min("ord").alias("mu"), F.count(F.lit(1)).alias("nu"))
    sc = (undecided.groupBy(F.col("rc").alias("cc"))
          .agg(F.min("ord").alias("mc"), F.count(F.lit(1)).alias("nc")))
    return su, sc


def _with_ends(base: DataFrame) -> DataFrame:
    """``base`` plus ``until``: the order of the next forced row of the same url, null if none follows.

    There the record that the row leaves, if it is accepted, is overwritten.
    """
    stats = (base.groupBy("u").agg(F.max(F.when(F.col("force"), F.col("ord"))).alias("last"), F.count(F.lit(1)).alias("n"))
             .filter(F.col("last").isNotNull()))
    marked = lookup_join(base, cut_lineage(stats), "u", "n", "left")
    open_ = F.coalesce(F.col("ord") <= F.col("last"), F.lit(False))  # the last one itself ends others
    scan = marked.filter(open_).drop("last").withColumn("at", F.when(F.col("force"), F.col("ord")))
    ended = running_before(scan, "u", F.col("ord").desc(), "at", F.min, F.least, "until").drop("at")
    endless = marked.filter(~open_).select(*base.columns, F.lit(None).cast(base.schema["ord"].dataType).alias("until"))
    return cut_lineage(ended.unionByName(endless))


def _held(rows: DataFrame, records: DataFrame, sc: DataFrame, n: int | None) -> DataFrame:
    """``rows`` plus ``held``: a record that ends (rc, ord, until) has the row's content at its place."""
    first = records.groupBy(F.col("rc").alias("cc")).agg(F.min("ord").alias("start")).join(sc.select("cc", "nc"), "cc")
    marked = cut_lineage(lookup_join(rows, first, "cc", "nc", "left", total=n))
    after = F.coalesce(F.col("ord") > F.col("start"), F.lit(False))
    no_end = F.lit(None).cast(rows.schema["ord"].dataType)
    scan = (marked.filter(after).drop("start").withColumn("row", F.lit(True)).withColumn("end", no_end)
            .unionByName(records.select(F.col("rc").alias("cc"), "ord", F.col("until").alias("end"), F.lit(False).alias("row")),
                         allowMissingColumns=True))
    scan = running_before(scan, "cc", F.col("ord").asc(), "end", F.max, F.greatest, "latest").filter("row")
    return (scan.select(*rows.columns, F.coalesce(F.col("latest") > F.col("ord"), F.lit(False)).alias("held"))
            .unionByName(marked.filter(~after).select(*rows.columns, F.lit(False).alias("held"))))


def _block(undecided: DataFrame, kept: DataFrame, su: DataFrame, sc: DataFrame, n: int | None = None, ends: bool = False) -> DataFrame:
    """Drop undecided rows that a kept row (earlier in ord) shares a key with.

    The kept rows' minima are joined to the group sizes (one row per key on
    both sides), then looked up by the undecided rows with hot keys broadcast.
    With ``ends`` a kept row holds its content only until its ``until``.
    """
    bu = kept.groupBy("u").agg(F.min("ord").alias("bu")).join(su.select("u", "nu"), "u")
    lasting = kept.filter(F.col("until").isNull()) if ends else kept
    bc = (lasting.groupBy(F.col("rc").alias("cc")).agg(F.min("ord").alias("bc"))
          .join(sc.select("cc", "nc"), "cc"))
    j = lookup_join(undecided, bu, "u", "nu", "left", total=n)
    j = lookup_join(j, bc, "cc", "nc", "left", total=n)
    blocked = (F.coalesce(F.col("ord") > F.col("bu"), F.lit(False))
               | F.coalesce(F.col("ord") > F.col("bc"), F.lit(False)))
    left = j.filter(~blocked).drop("bu", "bc")
    if ends:
        ending = kept.filter(F.col("until").isNotNull())
        if not ending.isEmpty():
            left = _held(left, ending, sc, n).filter(~F.col("held")).drop("held")
    return left


# Undecided rows (a few keys each) that one task may walk: a few dozen megabytes.
WALK_ROWS = 100_000


def _comparable(v):
    """A value of an order column such that Python compares it as Spark does (nulls first)."""
    if isinstance(v, dict):
        v = tuple(_comparable(x) for x in v.values())
    return (v is not None, v)


def _walked(undecided: DataFrame) -> DataFrame:
    """``(ord, keep)`` of a bounded rest of undecided rows, walked in order by one task."""
    ends = "until" in undecided.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        urls, contents = set(), {}  # content -> the end of the record that holds it longest
        never = (True, ())  # after every (False, place)
        for b in batches:
            keep = []
            places = b.column("ord").to_pylist() if ends else [None] * b.num_rows
            untils = b.column("until").to_pylist() if ends else places
            for u, cc, rc, place, until in zip(*(b.column(c).to_pylist() for c in ("u", "cc", "rc")), places, untils):
                held = cc is not None and cc in contents and contents[cc] > (False, _comparable(place))
                ok = u not in urls and not held
                if ok:
                    urls.add(u)
                    end = never if until is None else (False, _comparable(until))
                    contents[rc] = max(end, contents.get(rc, end))
                keep.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("ord"), pa.array(keep, pa.bool_())], ["ord", "keep"])

    return (undecided.coalesce(1).sortWithinPartitions("ord")
            .mapInArrow(walk, T.StructType([undecided.schema["ord"], T.StructField("keep", T.BooleanType())])))


def greedy_dedup(rows: DataFrame, force_col: str | None = None, walk_rows: int = WALK_ROWS) -> DataFrame:
    """D8 (+D9): sequential first-wins dedup over two keys, computed in rounds.

    Input columns: ``ord`` (unique order, any orderable type), ``u`` (url hash),
    ``cc`` (content hash to check, NULL when the row has no content) and ``rc``
    (content hash the row records when accepted); optional boolean
    ``force_col`` rows are admitted regardless and record their keys (null:
    not forced).  Output: ``ord, keep``.  A repeated ``ord`` has no defined
    order and is refused.

    Semantics: walking rows by ``ord``, a row is accepted unless an earlier
    *accepted* row has its url hash, or the latest record of some url holds its
    content hash; rejected rows record nothing.  A url gets a second record by
    a forced row only, and then the content of the first is forgotten.  Forced
    rows are known from the start, so every row's record, should it be
    accepted, is held over a known interval: from its place to the next forced
    row of its url.

    Each round keeps the undecided rows that are first
    in both of their key groups (they are accepted sequentially: everything
    before them that could block them is decided), then drops undecided rows
    that share a key with a newly kept, earlier row whose record still stands.
    The global first
    undecided row is always kept, so every round makes progress; typical
    data settles in 2-5 rounds.  Once a round leaves no more than ``walk_rows``
    undecided rows, one task walks this rest in order, so a chain of rows that
    alternate in url and content, which a round shortens by two rows only, does
    not take a round for each; beyond the bound, rounds go on.  Each round's
    state is checkpointed to the reliable checkpoint folder (lineage stays short and a
    lost executor only re-runs the current round).
    """
    force = F.coalesce(F.col(force_col), F.lit(False)) if force_col else F.lit(False)
    base = cut_lineage(rows.select("ord", "u", "cc", "rc", force.alias("force")))
    if not base.groupBy("ord").count().filter("count > 1").isEmpty():
        raise ValueError("dedup rows repeat an ord")
    ends = force_col is not None and not base.filter("force").isEmpty()
    keys = ["ord", "u", "cc", "rc"] + ["until"] * ends
    if ends:
        base = _with_ends(base)
    forced = base.filter("force").select(*[c for c in keys if c != "cc"])
    undecided = base.filter(~F.col("force")).select(*keys)
    decided = [forced.select("ord", F.lit(True).alias("keep"))]
    if ends:
        su0, sc0 = _group_sizes(undecided.unionByName(forced.withColumn("cc", F.col("rc"))))
        undecided = _block(undecided, forced, su0, sc0, ends=True)
    undecided = cut_lineage(undecided)
    while n := undecided.count():
        su, sc = _group_sizes(undecided)
        x = lookup_join(undecided, su, "u", "nu", "inner", total=n)
        x = lookup_join(x, sc, "cc", "nc", "left", total=n)
        keep = (F.col("ord") == F.col("mu")) & (F.col("cc").isNull() | F.col("mc").isNull() | (F.col("ord") <= F.col("mc")))
        x = cut_lineage(x.withColumn("k", keep).drop("mu", "mc"))
        kept = x.filter("k").select(*[c for c in keys if c != "cc"])
        decided.append(kept.select("ord", F.lit(True).alias("keep")))
        undecided = cut_lineage(_block(x.filter(~F.col("k")).select(*keys), kept, su, sc, n, ends))
        n = undecided.count()
        if n <= walk_rows:
            if n:
                decided.append(cut_lineage(_walked(undecided)))
            break
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    # every input row gets a verdict: rows not kept were blocked
    return (base.select("ord").join(out, "ord", "left")
            .select("ord", F.coalesce(F.col("keep"), F.lit(False)).alias("keep")))


def dedup_keys(df: DataFrame, content_col: str = "content", extra: tuple[str, ...] = ()) -> DataFrame:
    """Build the D8 key columns from ``url_hash``/``content_hash`` and content emptiness."""
    has_content = _has_content(df, content_col)
    return df.select("ord", F.col("url_hash").alias("u"),
                     F.when(has_content, F.col("content_hash")).alias("cc"),
                     F.col("content_hash").alias("rc"), *extra)


# --------------------------------------------------------------------- D11

def event_merge(items: DataFrame, group_col: str = "content_hash") -> DataFrame:
    """Per event group, the winner is the most authoritative, then the
    longest, then the earliest item; every other member becomes a duplicate
    row ``(title, url, merged_into, reason)`` pointing at the winner's id.

    The winner is found by ``max_by`` over a partial aggregation (no group is
    sorted in one task); losers are joined to it on the group key, with hot
    groups broadcast (``skew.lookup_join``).
    """
    rank_key = F.struct(F.col("source_weight"), F.col("n_chars"), (-F.col("ord")).alias("neg_ord"))
    winners = (items.groupBy(group_col)
               .agg(F.max_by(F.struct("ord", "story_id"), rank_key).alias("w"),
                    F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > 1)
               .select(group_col, F.col("w.ord").alias("winner_ord"), F.col("w.story_id").alias("merged_into"), "n"))
    return (lookup_join(items, winners, group_col, "n", "inner")
            .filter(F.col("ord") != F.col("winner_ord"))
            .select("ord", "title", "url", "merged_into", "winner_ord",
                    F.lit("same content as the kept story").alias("reason")))

"""Plan-shape checks: pushdown, pruning, no Python in hot paths, replay-safe sinks."""

import uuid

from pyspark.sql import functions as F

from broadsheet.functions import text as TX
from broadsheet.functions import urls as U
from broadsheet.operators import rank as R
from broadsheet.operators import summarize as SM
from broadsheet.session import ensure_checkpoint_dir
from broadsheet.sinks import library as LB
from broadsheet.sources import tables as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_paths_have_no_python(spark):
    a = S.articles(spark, SF)
    df = U.with_url_hash(a, "url").select(
        "url_hash", TX.content_hash("content").alias("c"), TX.word_count("content").alias("w"),
        R.source_weight(F.col("source"), F.col("url")).alias("sw"),
        SM.mock_summary(F.col("content"), F.col("title")).alias("md"))
    p = plan(df)
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "WholeStageCodegen" in p or "*(" in p


def test_scan_prunes_columns(spark):
    df = S.read_table(spark, SF, "documents").select("doc_id", "source").filter(F.col("source") == "src1")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in p
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p


def test_library_partition_pruning(spark):
    base = ensure_checkpoint_dir(spark) + f"/lib-{uuid.uuid4().hex}"
    a = S.articles(spark, SF)
    rows = (a.withColumn("author", F.lit(None).cast("string")).withColumn("published_date", F.col("date"))
            .withColumn("url_hash", F.sha2("url", 256)).withColumn("content_hash", F.sha2("content", 256))
            .withColumn("word_count", TX.word_count("content")).withColumn("summary", F.lit(""))
            .withColumn("stored_path", F.lit("p"))
            .withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("make_dt_interval(0, ord * 3, 0, 0)")))
    LB.write_library(LB.library_rows(rows), base)
    lib = spark.read.parquet(base)
    day = LB.library_for_date(lib, "2024-01-03")
    p = plan(day)
    assert "PartitionFilters: [isnotnull(year" in p and "(month#" in p
    assert day.count() == a.filter("ord * 3 >= 48 and ord * 3 < 72").count()


def test_stream_batch_replay_is_idempotent(spark):
    from broadsheet.plans.queries import RUN_TS, _raw_feeds, _source_file
    from broadsheet.sinks.seen_store import SeenStore
    from broadsheet.streaming.incremental import make_batch_writer
    base = ensure_checkpoint_dir(spark) + f"/replay-{uuid.uuid4().hex}"
    run = make_batch_writer(lambda: _raw_feeds(spark, SF), lambda: S.pages(spark, SF), base, RUN_TS, buckets=4)
    batch = _source_file(spark, SF).withColumn("file", F.lit("f0"))
    run(batch, 0)
    first = spark.read.parquet(base + "/outcomes").count()
    run(batch, 0)   # replay of the same batch id
    assert spark.read.parquet(base + "/outcomes").count() == first
    seen = spark.read.parquet(base + "/seen/gen-0/by_url")
    assert seen.count() == seen.select("url_hash").distinct().count() == SeenStore(spark, base + "/seen").latest().count()


def test_micro_batch_of_two_files(spark):
    """Lines of two files share positions; their order is (file, position) and every line has one outcome."""
    from broadsheet.streaming.incremental import make_batch_writer
    base = ensure_checkpoint_dir(spark) + f"/files-{uuid.uuid4().hex}"
    page = "<article>" + "word " * 60 + "{}</article>"
    pages = spark.createDataFrame([(i, f"https://p/{i}", page.format(i % 2)) for i in range(4)], "ord long, url string, html string")
    feeds = spark.createDataFrame([], "feed_url string, xml string")
    lines = [("f1", 0, "https://p/2"), ("f0", 0, "https://p/0"), ("f0", 1, "https://p/1"), ("f1", 1, "https://p/9")]
    run = make_batch_writer(lambda: feeds, lambda: pages, base, "2024-02-01 08:00:00")
    run(spark.createDataFrame(lines, "file string, pos long, value string"), 0)
    got = {r.url: (r.success, r.skipped) for r in spark.read.parquet(base + "/outcomes").collect()}
    assert got == {"https://p/0": (True, False), "https://p/1": (True, False), "https://p/2": (False, True), "https://p/9": (False, False)}


def test_unreadable_history_stops_the_batch(spark):
    import os

    import pytest

    from broadsheet.sinks.seen_store import read_state
    base = ensure_checkpoint_dir(spark).removeprefix("file:") + f"/broken-{uuid.uuid4().hex}"
    assert read_state(spark, base).batches == ()
    os.makedirs(base + "/commits")
    with open(base + "/commits/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        read_state(spark, base)


def _page_batches(spark, base, urls_of_batch, **kw):
    """A writer over pages of 60 words, and batches of lines."""
    from broadsheet.streaming.incremental import make_batch_writer
    page = "<article>" + "word " * 60 + "{}</article>"
    pages = spark.createDataFrame([(i, f"https://p/{i}", page.format(f"text{i % 7}")) for i in range(20)], "ord long, url string, html string")
    feeds = spark.createDataFrame([], "feed_url string, xml string")
    run = make_batch_writer(lambda: feeds, lambda: pages, base, "2024-02-01 08:00:00", buckets=4, **kw)
    return run, [spark.createDataFrame([("f", k, f"https://p/{i}") for k, i in enumerate(ids)], "file string, pos long, value string") for ids in urls_of_batch]


def test_a_batch_killed_between_sinks_is_invisible(spark, monkeypatch):
    import pytest

    from broadsheet.sinks.seen_store import SeenStore
    from broadsheet.streaming.incremental import read_library, read_outcomes
    base = ensure_checkpoint_dir(spark) + f"/atomic-{uuid.uuid4().hex}"
    run, (first, second) = _page_batches(spark, base, [[0, 1, 7], [2, 0, 8]])
    run(first, 0)
    before = sorted(map(str, read_outcomes(spark, base).collect()))
    with monkeypatch.context() as m:
        m.setattr(SeenStore, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            run(second, 1)
    assert sorted(map(str, read_outcomes(spark, base).collect())) == before
    assert read_library(spark, base).count() == 2 and SeenStore(spark, base + "/seen").latest().count() == 2
    run(second, 1)  # the same batch again
    got = {(r.batch_id, r.url): r.success for r in read_outcomes(spark, base).collect()}
    assert got == {(0, "https://p/0"): True, (0, "https://p/1"): True, (0, "https://p/7"): False,
                   (1, "https://p/2"): True, (1, "https://p/0"): False, (1, "https://p/8"): False}
    assert read_library(spark, base).count() == 3


def test_compaction_between_batches_changes_no_outcome(spark):
    from broadsheet.sinks.seen_store import SeenStore
    from broadsheet.streaming.incremental import read_outcomes
    base = ensure_checkpoint_dir(spark) + f"/compact-{uuid.uuid4().hex}"
    run, batches = _page_batches(spark, base, [[0, 1], [2, 7, 3], [1, 4, 9]], compact_every=1)  # texts repeat after seven pages
    for k, b in enumerate(batches):
        run(b, k)
    assert {(r.batch_id, int(r.url[10:])) for r in read_outcomes(spark, base).filter("success").collect()} == {(0, 0), (0, 1), (1, 2), (1, 3), (2, 4)}
    assert read_outcomes(spark, base).count() == 8 and SeenStore(spark, base + "/seen").state().generation == 2


def test_ingest_reads_html_of_wanted_pages_only(spark):
    from broadsheet.plans.ingest import wanted_pages
    pages = S.pages(spark, SF)
    urls = pages.filter("ord < 3").select("url")
    df = wanted_pages(pages, urls)
    p = plan(df)
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p   # HTML is not shuffled
    assert df.count() == 3


def test_pages_not_wanted_leave_at_the_scan_beyond_the_broadcast_bound(spark, monkeypatch):
    """With more keys than may be broadcast, bitmaps drop the other pages before any exchange."""
    from broadsheet.operators import bloom
    from broadsheet.plans import ingest
    monkeypatch.setattr(ingest, "BROADCAST_BYTES", 0)
    pages = spark.range(40_000).select(F.col("id").alias("ord"), F.concat(F.lit("https://p/"), F.col("id") % 30_000).alias("url"), F.lit("<p>x</p>").alias("html"))
    urls = pages.filter("ord % 9 = 0").select("url").unionByName(spark.createDataFrame([("https://gone/",), (None,)], "url string"))
    got = sorted(r.url for r in ingest.wanted_pages(pages, urls).collect())
    assert got == sorted({r.url for r in pages.filter("ord % 9 = 0").select("url").collect()})
    keys = pages.filter("ord < 30000 and ord % 9 = 0").select("url", "ord")
    buckets = bloom.buckets_for(keys.count())
    left = bloom.may_hold(pages.select("url", "ord", "html"), bloom.key_bitmaps(keys, ["url", "ord"], buckets), ["url", "ord"], buckets)
    assert left.join(keys, ["url", "ord"]).count() == keys.count() <= left.count() < keys.count() + 0.01 * pages.count()
    assert "BroadcastHashJoin" in plan(left) and "SortMergeJoin" not in plan(left)
    assert (bloom.buckets_for(0), bloom.buckets_for(5000), bloom.buckets_for(10**12)) == (1, 4, bloom.MAX_BUCKETS)


def test_a_month_is_written_by_many_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = S.articles(spark, SF).withColumn("url_hash", F.sha2("url", 256))
    lane = F.pmod(F.xxhash64("url_hash"), F.lit(n))
    assert rows.select(lane.alias("l")).distinct().count() > 1


def test_long_term_lists_lose_no_term(spark):
    from broadsheet.operators import search as SE
    cards = spark.createDataFrame([(1, 1, "a", "needle 1500", "", ["t"], "", "")],
                                  "day int, rank int, id string, title string, one_liner string, tags array<string>, subtitle string, source string")
    got = SE.story_search(cards, [f"needle {i}" for i in range(2000)], "day").collect()
    assert {r.term for r in got} == {"needle 1", "needle 15", "needle 150", "needle 1500"}
    index = spark.createDataFrame([(1, "t", "a")], "day int, tag string, id string")
    items = spark.createDataFrame([(1, "Other", "a")], "day int, name string, id string")
    kinds = SE.tag_filter(cards, index, ["t"] + [f"x{i}" for i in range(1500)], "day", items).collect()
    assert sorted((r.kind, r.place, r.tag) for r in kinds) == [("section", "Other", "t"), ("story", "1", "t")]

"""End to end through the sinks: ingest -> library + seen log -> daily digest text -> digest JSON."""

import json
import uuid

from pyspark.sql import functions as F

from broadsheet.operators import digest as DG
from broadsheet.plans import daily as DY
from broadsheet.plans import ingest as IG
from broadsheet.plans.queries import RUN_TS, _expanded
from broadsheet.session import ensure_checkpoint_dir
from broadsheet.sinks import library as LB
from broadsheet.sources import tables as S

SF = "/root/testdata/sf0.001"


def test_ingest_write_and_digests(spark):
    base = ensure_checkpoint_dir(spark) + f"/e2e-{uuid.uuid4().hex}"
    res = IG.ingest_batch(_expanded(spark, SF), S.pages(spark, SF), None, RUN_TS)
    IG.write_batch(res, base + "/library", base + "/seen")
    n_ok = res.outcomes.filter("success").count()
    lib = spark.read.parquet(base + "/library")
    seen = spark.read.parquet(base + "/seen")
    assert lib.count() == n_ok == seen.count()
    assert seen.select("url_hash").distinct().count() == n_ok
    day = LB.library_for_date(lib, RUN_TS[:10])
    assert day.count() == n_ok
    assert LB.library_for_date(lib, "2024-03-01").count() == 0

    lines = DY.digest_lines(day, [RUN_TS[:10], "2024-03-01"], generated_at="2024-02-01T09:00:00")
    DY.write_digests(lines, base + "/digests")
    text = "\n".join(r.value for r in spark.read.text(base + "/digests/d=2024-02-01").collect())
    assert text.startswith("# Daily Reading Digest: 2024-02-01\n")
    assert f"- **Articles ingested**: {n_ok}" in text and text.count("\n### ") == n_ok
    empty = "\n".join(r.value for r in spark.read.text(base + "/digests/d=2024-03-01").collect())
    assert "No articles ingested on this date." in empty

    items = LB.library_items(lib).withColumn("day", F.to_date("fetched_at")).withColumn(
        "ord", F.xxhash64("url_hash"))
    ranked = DG.top_k_per_group(items, "day", S.AS_OF, 30)
    doc = DG.digest_document(items, ranked, "day", "2024-02-01")
    DG.write_digest_json(doc, "day", base + "/json")
    raw = spark.read.text(base + "/json").first().value
    d = json.loads(raw)
    assert d["schema_version"] == "v1" and d["stats"]["items_in"] == n_ok
    assert len(d["top_stories"]) == min(12, n_ok) and d["sections"][0]["name"] == "Other"


def _records(spark, rows):
    """(n, url, content, title) as seen records in the order n."""
    df = spark.createDataFrame(rows, "n long, u string, c string, title string")
    return df.select(F.struct("n").alias("pos"), F.col("u").alias("url"), F.sha2("u", 256).alias("url_hash"), F.sha2("c", 256).alias("content_hash"), "title",
                     F.lit("2024-01-01").cast("timestamp_ntz").alias("fetched_at"), F.lit("p").alias("stored_path"), F.lit("rss").alias("source"))


def test_seen_store_reads_the_buckets_of_its_keys(spark):
    """A lookup resolves like the whole log, and reads at most one file per key and batch, also after compaction."""
    import random
    import uuid

    from broadsheet.operators import dedup as DD
    from broadsheet.session import ensure_checkpoint_dir
    from broadsheet.sinks.seen_store import SeenStore
    r = random.Random(3)
    store = SeenStore(spark, ensure_checkpoint_dir(spark) + f"/seen-{uuid.uuid4().hex}", buckets=24)
    keys = _records(spark, [(0, "u5", "c9", ""), (1, "unew", "c2", ""), (2, "u6", None, "")]).select("url_hash", "content_hash")
    assert store.lookup(keys) is None and store.latest() is None
    everything = None
    for b in range(2):
        part = _records(spark, [(b * 1000 + k, f"u{r.randrange(120)}", f"c{r.randrange(60)}", f"t{b}.{k}") for k in range(100)])
        store.put(part, b)
        store.commit(b)
        everything = part if everything is None else everything.unionByName(part)
        cols = ["url_hash", "first_pos", "content_hash", "title"]
        want = sorted(map(str, DD.seen_latest_for(everything, keys).select(cols).collect()))
        assert sorted(map(str, store.lookup(keys).select(cols).collect())) == want
        assert sorted(map(str, store.lookup(keys, before=b + 1).select(cols).collect())) == want
    store.put(_records(spark, [(9000, "u5", "c2", "uncommitted")]), 3)  # never committed
    assert sorted(map(str, store.lookup(keys).select(cols).collect())) == want


    def files(col):
        """Files of one table that a lookup of the first key reads, and of the whole table."""
        table = store._table("by_content" if col == "content_hash" else "by_url", store.state(), None)
        near = store._in_buckets(table, keys.filter(F.col("url_hash") == F.sha2(F.lit("u5"), 256)), col)
        scan = near._jdf.queryExecution().executedPlan().toString()
        assert "bucket" in scan[scan.index("PartitionFilters"):]
        return [x.select(F.input_file_name()).distinct().count() for x in (near, table)]

    for col in ("content_hash", "url_hash"):
        near, every = files(col)
        assert near <= 2 and every > 30  # a file a batch
    store.compact()
    state = store.state()
    assert (state.generation, state.through, state.batches) == (1, 1, ())
    near = F.col("url_hash").isin([x.url_hash for x in keys.collect()]) | F.col("content_hash").isin([x.content_hash for x in keys.collect()])
    want = sorted(map(str, DD.seen_latest_for(everything, keys).filter(near).select(cols).collect()))  # contents overwritten since are gone
    assert sorted(map(str, store.lookup(keys).filter(near).select(cols).collect())) == want
    assert [files(c)[0] for c in ("content_hash", "url_hash")] == [1, 1] and files("url_hash")[1] <= 24
    store.put(_records(spark, [(9001, "u5", "c2", "later")]), 3)
    store.commit(3)
    assert "later" in {x.title for x in store.lookup(keys).collect()}


def test_ingest_reads_its_expansion_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(url):
        seen.add(1)
        return url

    urls = [f"https://e/{k}" for k in range(3)]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "source_ord long, u string").coalesce(1)
    rows = rows.select("source_ord", F.lit(0).alias("pos"), F.col("u").alias("source_url"), counted("u").alias("url"), F.lit(1).cast("long").alias("n_entries"))
    pages = spark.createDataFrame([(k, u, "<body>" + f"word{k} " * 60 + "</body>") for k, u in enumerate(urls)], "ord long, url string, html string")
    res = IG.ingest_batch(rows.withColumn("ord", F.struct("source_ord", "pos")), pages, None, RUN_TS)
    assert sorted(r.url for r in res.outcomes.filter("success").collect()) == urls
    assert seen.value == 3

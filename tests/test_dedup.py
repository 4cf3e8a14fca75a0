"""Seen log, history lookup and the first-wins two-key dedup."""

import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import dedup as DD


def py_sequential(rows, forced=frozenset(), history=()):
    record, keep = dict(history), {}                # url -> content of its latest record
    for o, u, cc, rc in sorted(rows):
        keep[o] = o in forced or not (u in record or (cc is not None and cc in record.values()))
        if keep[o]:
            record[u] = rc
    return keep


def run(spark, rows, forced=frozenset()):
    df = spark.createDataFrame([(o, u, cc, rc, o in forced) for o, u, cc, rc in rows],
                               "ord long, u string, cc string, rc string, f boolean")
    out = DD.greedy_dedup(df, force_col="f" if forced else None)
    return {r.ord: r.keep for r in out.collect()}


def test_reference_example(spark):
    rows = [(1, "u1", "c1", "c1"), (2, "u2", "c1", "c1"), (3, "u2", "c2", "c2")]
    assert run(spark, rows) == {1: True, 2: False, 3: True}


def test_alternating_chain(spark):
    rows = []
    for i in range(24):
        rows.append((i, f"u{(i + 1) // 2}", f"c{i // 2}", f"c{i // 2}"))
    want = py_sequential(rows)
    assert run(spark, rows) == want


def test_random_batches_match_sequential(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        c = f"c{rnd.randrange(60)}"
        rows.append((i, f"u{rnd.randrange(80)}", None if rnd.random() < 0.05 else c, c))
    forced = frozenset(o for o, *_ in rows if rnd.random() < 0.05)
    assert run(spark, rows) == py_sequential(rows)
    assert run(spark, rows, forced) == py_sequential(rows, forced)


def _seen_lines(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "pos long, value string")


REC = '{{"url":"{u}","url_hash":"{h}","content_hash":"{c}","title":"{t}","fetched_at":"2024-01-01T00:00:00",' \
      '"stored_path":"p","source":"manual"}}'


def test_seen_log_last_wins_first_position(spark):
    lines = [REC.format(u="a", h="h1", c="c1", t="first"), "", "not json", '{"url": "x"}',
             REC.format(u="b", h="h2", c="c2", t="second"), REC.format(u="a", h="h1", c="c9", t="rewritten"),
             REC.format(u="z", h="h3", c="c2", t="third").replace("manual", "other")]
    latest = DD.seen_latest(DD.parse_seen_lines(_seen_lines(spark, lines)))
    got = {r.url_hash: (r.first_pos, r.title, r.content_hash) for r in latest.collect()}
    assert got == {"h1": (0, "rewritten", "c9"), "h2": (4, "second", "c2")}
    contents = {r.content_hash for r in DD.seen_content_hashes(latest).collect()}
    assert contents == {"c9", "c2"}          # c1 was overwritten and is forgotten


def test_duplicate_lookup(spark):
    lines = [REC.format(u="a", h="h1", c="c1", t="A"), REC.format(u="b", h="h2", c="cx", t="B"),
             REC.format(u="c", h="h3", c="cx", t="C")]
    latest = DD.seen_latest(DD.parse_seen_lines(_seen_lines(spark, lines)))
    batch = spark.createDataFrame([(1, "h1", "zz", "text"), (2, "h9", "cx", "text"), (3, "h9", "cx", ""),
                                   (4, "h8", "c7", "text")],
                                  "ord long, url_hash string, content_hash string, content string")
    got = {r.ord: (r.is_dup, r.reason) for r in DD.duplicate_lookup(batch, latest).collect()}
    assert got[1] == (True, "URL already seen: A")
    assert got[2] == (True, "Content matches existing: B")
    assert got[3] == (False, None)
    assert got[4] == (False, None)
    kept = {r.ord for r in DD.drop_seen(batch, latest).collect()}
    assert kept == {3, 4}


def test_event_merge(spark):
    df = spark.createDataFrame([(1, "t1", "u1", "h", 2, 100, "s1"), (2, "t2", "u2", "h", 5, 10, "s2"),
                                (3, "t3", "u3", "h", 5, 50, "s3"), (4, "t4", "u4", "k", 1, 1, "s4")],
                               "ord long, title string, url string, content_hash string, source_weight int, "
                               "n_chars int, story_id string")
    out = {r.ord: r.merged_into for r in DD.event_merge(df).collect()}
    assert out == {1: "s3", 2: "s3"}


def test_seen_latest_for_batch_is_exact(spark):
    rnd = random.Random(3)
    lines = [REC.format(u=f"u{i}", h=f"h{rnd.randrange(30)}", c=f"c{rnd.randrange(20)}", t=f"t{i}") for i in range(200)]
    recs = DD.parse_seen_lines(_seen_lines(spark, lines))
    batch = spark.createDataFrame([(i, f"h{rnd.randrange(40)}", f"c{rnd.randrange(25)}", "x") for i in range(60)],
                                  "ord long, url_hash string, content_hash string, content string")
    full = DD.duplicate_lookup(batch, DD.seen_latest(recs))
    part = DD.duplicate_lookup(batch, DD.seen_latest_for(recs, batch))
    assert sorted(map(tuple, full.select("ord", "is_dup", "reason").collect())) == \
        sorted(map(tuple, part.select("ord", "is_dup", "reason").collect()))
    assert sorted(r.ord for r in DD.drop_seen(batch, DD.seen_latest(recs)).collect()) == \
        sorted(r.ord for r in DD.drop_seen(batch, DD.seen_latest_for(recs, batch)).collect())


def test_hot_key_split_matches(spark):
    from broadsheet.operators.skew import lookup_join
    rows = spark.range(0, 5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        (F.col("id") % 97).cast("string")).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    split = lookup_join(rows, stats, "k", "n", "inner")
    plain = rows.join(stats.drop("n"), "k")
    assert sorted(map(tuple, split.select("k", "id", "m").collect())) == sorted(map(tuple, plain.select("k", "id", "m").collect()))
    assert "BroadcastHashJoin" in split._jdf.queryExecution().executedPlan().toString()


def test_dedup_with_hot_keys(spark, monkeypatch):
    import broadsheet.operators.skew as SK
    monkeypatch.setattr(SK, "MAX_HOT_KEYS", 4)
    rnd = random.Random(11)
    rows = [(i, "uhot" if i % 3 == 0 else f"u{rnd.randrange(50)}", "chot" if i % 4 == 0 else f"c{rnd.randrange(40)}",
             "chot" if i % 4 == 0 else f"c{rnd.randrange(40)}") for i in range(300)]
    rows = [(o, u, cc, cc) for o, u, cc, _ in rows]
    assert run(spark, rows) == py_sequential(rows)


def test_hot_content_in_the_batch(spark):
    """One content and one URL fill the batch: matches and misses, rows without keys, no row lost."""
    lines = [REC.format(u="a", h="h1", c="c1", t="A"), REC.format(u="b", h="h2", c="c2", t="B")]
    latest = DD.seen_latest(DD.parse_seen_lines(_seen_lines(spark, lines)))
    rows = [(i, "h2" if i % 3 == 0 else f"n{i}", "c1" if i % 2 else f"x{i}", i % 5 > 0) for i in range(300)] + [(300, None, None, False)]
    batch = spark.createDataFrame(rows, "ord long, url_hash string, content_hash string, content boolean")
    got = {r.ord: r.reason for r in DD.duplicate_lookup(batch, latest).collect()}
    want = {o: "URL already seen: B" if u == "h2" else "Content matches existing: A" if c == "c1" and has else None for o, u, c, has in rows}
    assert got == want
    assert {r.ord for r in DD.drop_seen(batch, latest).collect()} == {o for o, why in want.items() if why is None}


def test_struct_order_and_repeated_order(spark):
    import pytest
    rows = [((0, 2_000_000), "u1", "c1"), ((1, 0), "u1", "c2"), ((1, 1), "u2", "c1"), ((1, 1 << 21), "u3", "c2")]
    df = spark.createDataFrame([(o, u, c, c) for o, u, c in rows], "ord struct<source_ord:long,pos:long>, u string, cc string, rc string")
    assert {tuple(r.ord): r.keep for r in DD.greedy_dedup(df).collect()} == {(0, 2_000_000): True, (1, 0): False, (1, 1): False, (1, 1 << 21): True}
    with pytest.raises(ValueError):
        DD.greedy_dedup(df.unionByName(df.limit(1)))


def test_only_a_missing_log_is_empty(spark):
    import uuid

    from broadsheet.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark) + f"/log-{uuid.uuid4().hex}"
    assert DD.read_seen_jsonl(spark, base).count() == 0
    with pytest.raises(Exception):
        DD.read_seen_jsonl(spark, "nosuchscheme://x/y").collect()


def test_a_long_chain_takes_a_handful_of_rounds(spark, monkeypatch):
    """10,000 rows, each sharing its url with one neighbour and its content with the other; and random rows with any bound."""
    rounds = []
    sizes = DD._group_sizes
    monkeypatch.setattr(DD, "_group_sizes", lambda df: rounds.append(1) or sizes(df))
    chain = [(i, f"u{i // 2}", f"c{(i + 1) // 2}", f"c{(i + 1) // 2}") for i in range(10_000)]
    schema = "ord long, u string, cc string, rc string"
    got = {r.ord: r.keep for r in DD.greedy_dedup(spark.createDataFrame(chain, schema).repartition(5)).collect()}
    assert got == py_sequential(chain) and len(rounds) <= 3
    r = random.Random(11)
    rows = [(i, f"u{r.randrange(60)}", f"c{r.randrange(60)}" if r.random() < 0.9 else None, f"c{r.randrange(60)}") for i in range(200)]
    rows = [(o, u, c, c or rc) for o, u, c, rc in rows]
    for bound in (0, 40, 1000):
        got = {x.ord: x.keep for x in DD.greedy_dedup(spark.createDataFrame(rows, schema), walk_rows=bound).collect()}
        assert got == py_sequential(rows)


def test_a_forced_row_forgets_the_old_content(spark):
    rows = [(1, "u1", "c1", "c1"), (2, "u2", "c1", "c1"), (3, "u1", "c2", "c2"), (4, "u3", "c1", "c1"),
            (5, "u4", "c2", "c2"), (6, "u1", "c1", "c1"), (7, "u5", "c2", "c2"), (8, "u6", "c1", "c1")]
    want = {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False}
    assert py_sequential(rows, {3, 6}) == want
    assert run(spark, rows, frozenset({3, 6})) == want


@pytest.mark.parametrize("seed", range(3))
def test_forced_overwrites_with_history_match_the_walk(spark, monkeypatch, seed):
    """A hot url and a hot content, a third of the rows forced, records of the history overwritten; by rounds only and by the walk."""
    import broadsheet.operators.skew as SK
    monkeypatch.setattr(SK, "MAX_HOT_KEYS", 4)
    rnd = random.Random(seed)
    pick = lambda kind, n: f"{kind}hot" if rnd.random() < 0.2 else f"{kind}{rnd.randrange(n)}"
    rows = []
    for i in range(150):
        c = pick("c", 30)
        rows.append(((i // 40, i % 40), pick("u", 60), None if rnd.random() < 0.05 else c, c))
    forced = frozenset(o for o, *_ in rows if rnd.random() < 0.3)
    history = {pick("u", 60): pick("c", 30) for _ in range(25)}
    want = py_sequential(rows, forced, history.items())
    assert any(want[o] for o, u, cc, _ in rows if o not in forced and cc in history.values())  # something was forgotten
    latest = spark.createDataFrame([(u, c, n, "t") for n, (u, c) in enumerate(history.items())],
                                   "url_hash string, content_hash string, first_pos long, title string")
    batch = spark.createDataFrame([(o, u, rc, cc is not None, o in forced) for o, u, cc, rc in rows],
                                  "ord struct<a:long,b:long>, url_hash string, content_hash string, content boolean, f boolean")
    unseen = DD.drop_seen(batch.filter("not f"), latest, forced=batch.filter("f")).unionByName(batch.filter("f"))
    keys = DD.dedup_keys(unseen, extra=("f",)).persist()
    for bound in (10, 1000):
        got = {tuple(r.ord): r.keep for r in DD.greedy_dedup(keys, force_col="f", walk_rows=bound).collect()}
        assert {o: got.get(o, False) for o in want} == want


def test_running_before(spark):
    from broadsheet.operators.running import running_before
    rnd = random.Random(5)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", i, rnd.randrange(1000) if i % 4 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(4)
    got = {r.o: r.m for r in running_before(df, "k", F.col("o").asc(), "v", F.max, F.greatest, "m").collect()}
    for k, o, _ in rows:
        before = [v for k2, o2, v in rows if k2 == k and o2 < o and v is not None]
        assert got[o] == (max(before) if before else None)

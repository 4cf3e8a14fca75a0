"""Scores and ranking (C1-C5, C8) with literal fixtures."""

from pyspark.sql import functions as F

from broadsheet.functions.dates import freshness_score, parse_loose_date
from broadsheet.operators import rank as R

AS_OF = "2024-01-31 12:00:00"


def test_date_cases(spark):
    cases = [(None, 2.0), ("", 2.0), ("2024-1-5", 2.0), ("2024-1-30T1:2:3Z", 5.0), ("2024-01-30T10:00:00+02:00", 5.0),
             ("2024-01-30T10:00:60", 2.0), ("2024-02-30", 2.0), (" 2024-01-30", 2.0), ("2025-01-01", 5.0),
             ("2024-01-30", 5.0), ("2024-01-29", 4.0), ("2024-01-28", 4.0), ("2024-01-27", 3.0),
             ("2024-01-24", 3.0), ("2024-01-23", 2.0), ("2024-01-01", 2.0), ("2023-12-31", 1.0), ("bad", 2.0),
             ("2024-01- 5", 2.0), ("2024-1-1", 2.0), ("2023-12-1", 1.0), ("2024-01-30t10:00:00z", 5.0)]
    df = spark.createDataFrame(cases, "d string, want double")
    for r in df.select("d", "want", freshness_score(F.col("d"), F.lit(AS_OF).cast("timestamp_ntz")).alias("f")).collect():
        assert r.f == r.want, r.d


def test_length_cases(spark):
    cases = [("x" * 100, None, 1.0), ("x" * 101, None, 2.0), ("x" * 500, None, 2.0), ("x" * 501, None, 3.0),
             ("x" * 2000, None, 3.0), ("x" * 2001, None, 4.0), ("x" * 5000, None, 4.0), ("x" * 5001, None, 5.0),
             ("", "y" * 600, 3.0), (None, None, 1.0)]
    df = spark.createDataFrame(cases, "c string, s string, want double")
    for r in df.select("want", R.length_score(F.col("c"), F.col("s")).alias("l")).collect():
        assert r.l == r.want


def test_source_weight_order(spark):
    cases = [("metadata blog", "https://x.com", 5), (None, "https://arxiv.org/abs", 4), ("Reddit", "https://github.com", 3),
             ("unknown", "https://example.com", 2), ("hacker news", "https://news.ycombinator.com", 2)]
    df = spark.createDataFrame(cases, "source string, url string, want int")
    for r in df.select("want", R.source_weight(F.col("source"), F.col("url")).alias("w")).collect():
        assert r.w == r.want


def test_pre_rank_ties_and_plan(spark):
    rows = [(i, f"t{i}", f"https://blog.example.com/{i}", "s", "2024-01-30", "x" * 10) for i in range(50)]
    df = spark.createDataFrame(rows, "ord long, title string, url string, source string, date string, content string")
    top = R.pre_rank(df, AS_OF, top_k=30)
    got = [r.ord for r in top.orderBy("rank").collect()]
    assert got == list(range(30))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_rolling_window(spark):
    df = spark.createDataFrame([(1, "2024-01-25"), (2, "2024-01-24"), (3, "2024-01-31"), (4, None), (5, "x")],
                               "ord long, date string")
    assert sorted(r.ord for r in R.rolling_window(df, "2024-01-31").collect()) == [1, 3]


def test_positions_of_a_large_group(spark):
    """One group holds two thirds of the rows and lies in several ranges; nulls are a group; no window over a whole group."""
    rows = [(None if k % 9 == 0 else "big" if k % 3 else f"g{k % 5}", (k * 7919) % 1000, k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, t long, k long")
    out = R.position_within(df, "g", ["t", "k"])
    want, held = {}, {}
    for g, _, k in sorted(rows, key=lambda r: (r[1], r[2])):
        held[g] = held.get(g, 0) + 1
        want[k] = (g, held[g])
    assert {r.k: (r.g, r.position) for r in out.collect()} == want
    assert df.repartitionByRange(8, "g", "t", "k").withColumn("p", F.spark_partition_id()).filter("g = 'big'").select("p").distinct().count() > 1


def test_trending_daily_equals_each_window(spark):
    """Every window against the plain definition: gaps, a hot entity, repeated mentions, null sources, undated rows."""
    import datetime
    import random

    from broadsheet.operators.digest import trending, trending_daily
    rnd = random.Random(2)
    start = datetime.date(2024, 2, 20)
    rows = [("hot" if rnd.random() < 0.4 else f"e{rnd.randrange(6)}", None if rnd.random() < 0.1 else f"s{rnd.randrange(8)}",
             None if rnd.random() < 0.05 else start + datetime.timedelta(rnd.choice((0, 1, 2, 3, 9, 15, 16, 40)))) for _ in range(160)]
    rows += rows[:20] + [(None, f"s{i}", start) for i in range(3)]
    df = spark.createDataFrame(rows, "entity string, source string, day date")
    got = sorted((str(r.day), str(r.entity), r.n_sources) for r in trending_daily(df).collect())
    want = []
    for k in range(-8, 60):
        day = start + datetime.timedelta(k)
        per = {}
        for e, s, d in rows:
            if d is not None and day - datetime.timedelta(6) <= d <= day:
                per.setdefault(e, set()).add(s)
        want += [(str(day), str(e), len(s)) for e, s in per.items() if len(s) >= 3]
    assert got == sorted(want) and len(got) > 40
    day = start + datetime.timedelta(9)
    one = df.filter((df.day > day - datetime.timedelta(7)) & (df.day <= day))
    assert sorted((str(r.entity), r.n_sources) for r in trending(one).collect()) == [(e, n) for d, e, n in got if d == str(day)]
    assert trending_daily(df.limit(0)).count() == 0

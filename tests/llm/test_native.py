"""Quality rules, exact dedup, mixing and sharding against plain Python."""
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from broadsheet.llm import exact_dedup, mixing, quality_rules, sharding
from broadsheet.llm.common import lookup, ranked
from tests_llm_helpers import WORD, slow_dedup, slow_rules, slow_targets

@pytest.mark.parametrize("name", ["edge", "small"])
def test_rules_measure_like_plain_python(request, name):
    docs = request.getfixturevalue(name)
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.ledger(docs, carry=["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[c] for c in cols) == slow_rules(r["text"]), r["doc_id"]
        n, _, _, _, rep = slow_rules(r["text"])
        assert bool(r["fail_bits"] & quality_rules.mask("base")) == (n < 20 or 100 * rep > 30 * n)


def test_policies_and_ablations_use_the_stored_bits(small):
    led = quality_rules.ledger(small).cache()
    bits = [r["fail_bits"] for r in led.collect()]
    m = quality_rules.mask("v2")
    kept = quality_rules.apply_policy(led, "v2").filter("kept").count()
    assert kept == sum(b & m == 0 for b in bits)
    for r in quality_rules.ablations(led, "v2").collect():
        b = 1 << quality_rules.RULES.index(r["rule"])
        assert (r["failed"], r["only"], r["kept_without"]) == (
            sum(x & b != 0 for x in bits), sum(x & m == b for x in bits), kept + sum(x & m == b for x in bits))


def test_rules_on_empty_tables_and_clashing_columns(empty, small):
    assert quality_rules.ledger(empty).count() == 0
    assert [r["kept"] for r in quality_rules.ablations(quality_rules.ledger(empty), "v1").select(F.col("kept_without").alias("kept")).collect()] == [0] * 4
    odd = small.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("fail_bits", F.lit(0))
    out = quality_rules.passing(odd)
    assert out.columns == odd.columns and out.count() == quality_rules.passing(small).count()


@pytest.mark.parametrize("name", ["edge", "small"])
@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha", "colliding"])
def test_exact_dedup(request, name, digest):
    docs = request.getfixturevalue(name)
    got = Counter(map(tuple, exact_dedup.exact_dedup(docs, digest).collect()))
    assert got == slow_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_distinct_documents_keep_all_columns(edge, empty):
    out = exact_dedup.distinct_documents(edge.withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit("k")))
    want = slow_dedup([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert out.columns == [*edge.columns, "digest", "keep_id"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(k[0] for k, n in want.items() if k[3] for _ in range(n))
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.distinct_documents(empty).count() == 0


@pytest.mark.parametrize("name", ["edge", "small"])
def test_mix_meets_targets(request, name):
    docs = request.getfixturevalue(name)
    rows = mixing.mix(docs).collect()
    src = defaultdict(int)
    for r in docs.collect():
        src[r["source"]] += len(WORD.findall(r["text"] or ""))
    want, taken, largest = slow_targets(src), defaultdict(int), defaultdict(int)
    assert len(rows) == docs.count()
    for r in rows:
        assert r["source_size"] == src[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in src:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_tilt_solves_the_dual(small):
    """Rates are cap * logistic(lambda * z) and meet the targets before rounding."""
    import math
    rows = mixing.mix(small).collect()
    per = defaultdict(list)
    for r in rows:
        per[r["source"]].append(r)
    for rs in per.values():
        assert sum(r["rate"] * r["size"] for r in rs) == pytest.approx(rs[0]["target"], rel=1e-6)
        mean = rs[0]["source_size"] / len(rs)
        lams = [math.log(r["rate"] / (2 - r["rate"])) * mean / r["size"] for r in rs if r["size"] and 0.001 < r["rate"] < 1.999]
        assert not lams or max(lams) - min(lams) < 1e-6


def test_mixed_documents_tell_rows_of_one_id_apart(spark):
    """Rows that share id, source and word count but not the text keep their own copies."""
    docs = spark.createDataFrame([(k % 3 or None, f"text number w{k} of many", "a") for k in range(60)], "doc_id long, text string, source string")
    want = Counter(r["copies"] for r in mixing.mix(docs).collect())
    assert want[1] and want[2]
    got = Counter(r["text"] for r in mixing.mixed_documents(docs).collect())
    assert Counter(got.values()) == Counter({k: n for k, n in want.items() if k})


def test_mix_by_either_join_and_its_failure(edge, monkeypatch):
    want = sorted(map(str, mixing.mixed_documents(edge).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert sorted(map(str, mixing.mixed_documents(edge).collect())) == want and want
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.raises(ArithmeticError):
        mixing.mix(edge)


def test_mixed_documents_follow_copies(edge, empty):
    d = edge.filter("doc_id is not null and doc_id <> 5").withColumn("copies", F.lit(7))
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(d).collect()}
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in want.items() if v})
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def slow_jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("name", ["edge", "small", "empty"])
def test_shards(request, name):
    docs = request.getfixturevalue(name)
    rows = sharding.shard_documents(docs).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    slots = defaultdict(list)
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (slow_jump(r["doc_id"] or 0, 16), slow_jump(r["doc_id"] or 0, 17))
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jump_of_extreme_keys(spark):
    keys = [0, 1, -1, 2**63 - 1, -2**63, 123456789012345, *range(-50, 50)]
    for n in (1, 2, 16, 1000):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(F.col("k"), n).alias("s")).collect()
        assert all(r["s"] == slow_jump(r["k"], n) for r in got)


def test_lookup_and_ranked_under_skew(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") + 100).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")).filter("k is not null")
    got = lookup(rows, stats, "k", "n", F.col("id")).collect()
    want = {r["k"]: (r["n"], r["m"]) for r in stats.collect()}
    assert len(got) == 6000 and all((r["n"], r["m"]) == want.get(r["k"], (None, None)) for r in got)
    order = ranked(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), [F.col("v")], "rank").collect()
    assert all(r["v"] == r["rank"] for r in order)

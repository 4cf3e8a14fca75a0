"""N-gram Jaccard join and substring dedup against plain Python."""
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import blocks, ngram_join, substring_dedup
from broadsheet.llm.common import connected
from broadsheet.llm.fm_index import FMIndex, WaveletMatrix
from tests_llm_helpers import WORD, Sets, slow_components


def near_rows(seed, families, copies):
    """Families of texts that differ in a few words, some of them chains of small steps."""
    r = random.Random(seed)
    out = []
    for _ in range(families):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 12, 40, 90]))]
        for _ in range(copies):
            out.append(" ".join(words))
            for _ in range(r.choice([0, 1, 1, 2, 6])):
                words[r.randrange(len(words))] = f"w{r.randrange(400)}"
            if r.random() < 0.2:
                words.append("more")
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("n,percent,chunk,block", [(4, 85, 1000, 2000), (5, 80, 3, 4), (2, 60, 2, 2)])
def test_components(spark, n, percent, chunk, block):
    rows = near_rows(n, 12, 14)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter(map(tuple, ngram_join.components(docs, n, percent, chunk, block).collect())) == slow_components(rows, n, percent)


def test_components_of_odd_rows(edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = ngram_join.components(edge.withColumn("component_id", F.lit("x")), 4, 85)
    assert Counter(map(tuple, got.collect())) == slow_components(rows, 4, 85)
    assert ngram_join.components(empty).count() == 0


def test_one_of_each_keeps_the_smallest(spark, edge):
    rows = near_rows(3, 6, 6)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    want = {c for i, _, c in slow_components(rows, 5, 80)}
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want
    assert ngram_join.one_of_each(edge).filter("doc_id is null").count() == 2


def test_linked_sets_share_a_signature():
    """Also where whole texts are tiny, and for sets at the edge of a band."""
    r = random.Random(5)
    for percent in (60, 80, 85, 95):
        for size in [*range(1, 60), 200, 501]:
            for _ in range(3):
                base = [r.getrandbits(64) for _ in range(size)]
                gone = r.randrange(size + 1)
                other = base[gone:] + [r.getrandbits(64) for _ in range(r.randrange(3))]
                if set(base) == set(other) or 100 * len(set(base) & set(other)) < percent * len(set(base) | set(other)):
                    continue
                values, offs = [], [0]
                for s in (base, other):
                    values += sorted(set(s))
                    offs.append(len(values))
                sig, of, own = ngram_join.signatures(np.array(values, np.uint64), np.array(offs), percent)
                both = set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())
                assert both & set(sig[own].tolist()), (percent, size, gone)


def test_possible_pairs_hold_all_linked_ones():
    """Sets of all sizes and distances, of one number of cells and of several."""
    r = random.Random(2)
    for percent in (30, 60, 80, 95, 100):
        sets = []
        for size in (1, 2, 7, 60, 64, 65, 120, 130, 500, 1030):
            base = [r.getrandbits(64) for _ in range(size)]
            for gone in (0, 0, size // 40, size // 12, size // 6, size // 3):
                sets.append(sorted(base[gone:] + [r.getrandbits(64) for _ in range(r.choice([0, gone]))]))
        r.shuffle(sets)
        offs = np.cumsum([0, *map(len, sets)])
        cells, first = ngram_join.sketches(np.array([x for s in sets for x in s], np.uint64), offs)
        may = ngram_join.possible(np.diff(offs), [cells[a:b] for a, b in zip(first, first[1:])], percent)
        assert (may == may.T).all() and (percent < 80 or may.sum() < len(sets) ** 2 / 4)
        for i, a in enumerate(map(set, sets)):
            for j, b in enumerate(map(set, sets)):
                assert may[i, j] or 100 * len(a & b) < percent * len(a | b), (percent, len(a), len(b))


@pytest.mark.parametrize("block", [2000, 8])
def test_texts_with_a_common_passage_are_not_sent_for_each_list(spark, monkeypatch, block):
    """Unlike texts share signatures of a passage; only near copies are compared, each text in one task."""
    r = random.Random(4)
    passage = [f"p{k}" for k in range(12)]
    rows = []
    for i in range(240):
        w = [f"x{r.randrange(10**9)}" for _ in range(40)]
        rows += [(3 * i, " ".join(w + passage))] + [(3 * i + k, " ".join(w + passage + [f"y{k}"])) for k in (1, 2) if i % 8 == 0]
    sent, links = [], ngram_join.links
    monkeypatch.setattr(ngram_join, "links", lambda docs, tasks, *a: (sent.extend(tuple(x) for x in tasks.select("task", "doc").collect()), links(docs, tasks, *a))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.components(docs, 5, 80, block // 2, block).collect()
    assert Counter(map(tuple, got)) == slow_components(rows, 5, 80)
    assert Counter(d for _, d in sent) == Counter(i for i, _ in rows if i // 3 % 8 == 0)


def test_many_near_copies_are_linked(spark):
    """More of them than a task may hold."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(x if r.random() > 0.004 else f"v{r.randrange(10**6)}" for x in words)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow_components(rows, 5, 80)
    assert len({c for _, _, c in want}) < 45
    assert Counter(map(tuple, ngram_join.components(docs, 5, 80, 6, 12).collect())) == want


def test_connected(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    uf = Sets()
    for a, b in edges:
        uf.join(a, b)
    for contract in (200_000, 20):  # done by one contraction; and by rounds of stars
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000 if contract > 20 else 5)
        got = {x["node"]: x["root"] for x in connected(spark.createDataFrame(edges, "u long, v long"), contract).collect()}
        assert all(got.get(x, x) == uf.find(x) for x in uf.up)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_repeats(rows, window):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k:k + window])
            first[g] = min(i, first.get(g, i))
    out = Counter()
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), left, hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


def repeat_rows(seed):
    """Texts of few words with passages copied between and within them, some blanks odd, some texts long and monotone."""
    r = random.Random(seed)
    passages = [[f"w{r.randrange(30)}" for _ in range(r.randrange(10, 60))] for _ in range(6)]
    out = []
    for _ in range(60):
        w = []
        for _ in range(r.randrange(6)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            w += p[a:] if r.random() < 0.7 else [f"w{r.randrange(30)}" for _ in range(20)]
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    out += ["same " * 500, "same " * 90, "", None, out[3], out[3]]
    return list(enumerate(out)) + [(7, out[7]), (7, "another text of this id " * 5), (None, out[5])]


@pytest.mark.parametrize("window,gram", [(13, 6), (8, 3), (5, 5)])
def test_remove_repeats(spark, window, gram):
    rows = repeat_rows(window)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("x")).repartition(5)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"])
                  for r in substring_dedup.remove_repeats(docs, window, gram, texts=True).collect())
    assert got == slow_repeats(rows, window)


@pytest.mark.parametrize("window,gram", [(13, 6), (8, 3)])
def test_remove_repeats_of_hot_anchors(spark, window, gram):
    rows = repeat_rows(window)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (0, 8):
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"])
                      for r in substring_dedup.remove_repeats(docs, window, gram, texts=True, hot=hot).collect())
        assert got == slow_repeats(rows, window)


def test_no_shard_holds_all_of_a_common_passage(spark):
    """A passage shorter than the window, in other words each time, and one longer than the window."""
    r = random.Random(9)
    around = lambda: " ".join(f"x{r.randrange(10**9)}" for _ in range(20))
    for passage in (9, 20):
        common = " ".join(f"p{k}" for k in range(passage))
        docs = spark.createDataFrame([(i, f"{around()} {common} {around()}") for i in range(1200)], "doc_id long, text string")
        dealt, buckets = substring_dedup._dealt(docs)
        shards = [(x["n"], x["p"]) for x in substring_dedup.routed(dealt, buckets, 13, 6, substring_dedup.HOT).groupBy("shard").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("segment").isNotNull(), F.size("places") / 3)).alias("p")).collect()]
        for held in zip(*shards):  # rows, places
            assert max(held) < 0.3 * sum(held)
    assert substring_dedup.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] == 1199 * 20


def test_remove_repeats_of_odd_rows(edge, small, empty):
    for docs in (edge, small):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = Counter(map(tuple, substring_dedup.remove_repeats(docs, texts=True).collect()))
        assert got == slow_repeats(rows, 13)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_wavelet_ranks():
    r = np.random.default_rng(0)
    for top in (1, 2, 7, 300):
        s = r.integers(0, top, 700)
        w = WaveletMatrix(s)
        for c in range(int(s.max()) + 1):
            assert (w.rank(np.full(701, c), np.arange(701)) == np.concatenate([[0], np.cumsum(s == c)])).all()


def test_backward_search_finds_all_occurrences():
    r = random.Random(3)
    for window in (2, 5, 13):
        texts = [[r.randrange(1, 4) for _ in range(r.randrange(1, 50))] for _ in range(12)]
        seq = np.array([x for t in texts for x in (*t, 0)])
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = ends - [len(t) for t in texts]
        index = FMIndex(seq, window)
        lo, hi = index.matches(starts, ends)
        where = {}
        for a, z in zip(starts, ends):
            for p in range(a, z - window + 1):
                where.setdefault(tuple(seq[p:p + window]), set()).add(p)
        for p in range(len(seq)):
            want = where.get(tuple(seq[p:p + window]), set()) if any(a <= p <= z - window for a, z in zip(starts, ends)) else set()
            assert set(index.order[lo[p]:hi[p]].tolist()) == want


def test_words_are_compared_by_bytes(monkeypatch):
    data, offs = blocks.text_bytes(pa.array(["a bb a ccc bb", "bb d"]))
    s, e, _ = blocks.words(data, offs)
    for weak in (False, True):
        if weak:  # all words collide
            monkeypatch.setattr(substring_dedup, "word_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
        n = substring_dedup.word_numbers(data, s, e).tolist()
        assert n[0] == n[2] and n[1] == n[4] == n[5] and len(set(n)) == 4

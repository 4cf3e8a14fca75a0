"""WARC round trips, sampled segmentation, language ID and the quality classifier against plain Python."""
import gzip
import hashlib
import io
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm import blocks, language_id, quality_classifier, segment, warc
from broadsheet.llm.common import crc32_of_id

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
SAME = "<html>" + "same page é " * 30
PAGE_ROWS = [(5, "http://a/x y", SAME), (3, None, SAME), (9, "http://b/ü", SAME), (1, "http://c", "short"), (2, "http://c", "short"),
             (4, "u", None), (6, "u", ""), (None, "u", SAME), (None, None, None), (3, "twice", SAME), (7, "big", "x" * 400_000 + "\x1f"),
             (8, "u", "WARC/1.0\r\n\r\n" + "z" * 200)]


def slow_warc(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        ref = first.get(h) if h and i is not None else None
        revisit = ref is not None and ref < i
        out[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", ref if revisit else None] += 1
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGE_ROWS, PAGES).repartition(3)


def test_warc_round_trip(pages, spark):
    assert Counter(map(tuple, warc.round_trip(pages.withColumn("digest", F.lit(1))).collect())) == slow_warc(PAGE_ROWS)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_reads_every_record_once_for_any_split(pages, spark):
    manifest = warc.write(pages.coalesce(1), warc.archive_folder(spark))
    want = sorted((r["page_id"] is None, r["page_id"] or 0, r["offset"]) for r in warc.read(manifest).collect())
    assert len(want) == len(PAGE_ROWS)
    for split in (37, 1000, 4096):
        got = warc.read(manifest, split=split, payloads=True).collect()
        assert sorted((r["page_id"] is None, r["page_id"] or 0, r["offset"]) for r in got) == want
        html = {(r["page_id"], r["html"]) for r in got if r["record_type"] == "response"}
        assert html <= {(i, h or "") for i, _, h in PAGE_ROWS}


def test_warc_members_are_plain_gzip_and_damage_is_reported(spark, pages):
    manifest = warc.write(pages.coalesce(1), warc.archive_folder(spark))
    store, path = warc.filesystem(manifest.first()["file"])
    with store.open_input_file(path) as f:
        raw = f.read()
    assert gzip.decompress(raw).count(b"WARC-Type: ") == len(PAGE_ROWS)
    noise = b"\x1f\x8b\x08 no member " + raw
    hits = list(warc.members(warc.Window(io.BytesIO(noise), len(noise)), 0, len(noise)))
    assert len(hits) == len(PAGE_ROWS)
    cut = raw[:-9]
    with pytest.raises(ValueError):
        list(warc.members(warc.Window(io.BytesIO(cut), len(cut)), 0, len(cut)))
    bad = bytearray(raw)
    bad[len(raw) - 6] ^= 255
    with pytest.raises(ValueError):
        list(warc.members(warc.Window(io.BytesIO(bytes(bad)), len(bad)), 0, len(bad)))


def test_warc_of_other_writers(spark):
    """Info, request, resource and metadata records, sha1 and missing digests, chunked payloads and foreign revisits."""
    import base64

    def record(kind, block, http=False, **fields):
        head = [f"WARC-Type: {kind}", f"Content-Length: {len(block)}", f"Content-Type: {'application/http; msgtype=x' if http else 'text/plain'}"]
        head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
        return gzip.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")

    page = b"<html>page</html>"
    b32 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    raw = [record("warcinfo", b"software: x\r\n\r\nmore"), record("request", b"GET / HTTP/1.1\r\n\r\n", True),
           record("response", b"HTTP/1.1 200 OK\r\n\r\n" + page, True, WARC_Payload_Digest=b32(page), WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="http://x/"),
           record("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabcde", True, WARC_Payload_Digest=b32(b"abcde")),
           record("revisit", b"HTTP/1.1 304\r\n\r\n", True, WARC_Payload_Digest=b32(page), WARC_Refers_To="<urn:uuid:1>"),
           record("resource", page, WARC_Payload_Digest="blake9:zz"), record("metadata", b"")]

    def rows(parts):
        base = warc.archive_folder(spark)
        store, path = warc.filesystem(base)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/a.warc.gz", compression=None) as f:
            f.write(b"".join(parts))
        manifest = spark.createDataFrame([(f"{base}/a.warc.gz", sum(map(len, parts)), len(parts))], warc.MANIFEST)
        return warc.resolved(warc.read(manifest, split=100)).orderBy("offset").collect()

    sha = lambda x: hashlib.sha256(x).hexdigest()
    blocks_ = [b"software: x\r\n\r\nmore", b"", page, b"5\r\nabcde", None, page, b""]
    assert [(r["record_type"], r["payload_bytes"], r["payload_digest"], r["page_id"], r["refers_to"]) for r in rows(raw)] == [
        (k, None if x is None else len(x), None if x is None else sha(x), None, None)
        for k, x in zip(["warcinfo", "request", "response", "response", "revisit", "resource", "metadata"], blocks_)]
    with pytest.raises(Exception, match="does not match"):
        rows([record("response", b"HTTP/1.1 200 OK\r\n\r\nother", True, WARC_Payload_Digest=b32(page))])


@pytest.fixture(scope="module")
def vocabulary():
    return segment.Vocabulary(open(segment.model_path(), "rb").read())


def test_segmentation_round_trips(spark, edge, small, empty):
    odd = edge.unionByName(edge.limit(1).withColumn("text", F.lit("a▁b  c\n\té漢字🙂\x00 " + "▁" * 3)))
    for docs in (odd, small):
        assert all(r["lossless"] for r in segment.round_trip(docs).collect())
    assert segment.round_trip(empty).count() == 0
    clash = small.withColumn("pieces", F.lit(1))
    out = segment.decode(segment.encode(clash))
    assert out.columns == [*small.columns, "pieces", "decoded"]
    assert out.filter(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert segment.encode(out, decoded=True).columns == [*small.columns, "pieces", "decoded"]
    lists = spark.createDataFrame([(1, None), (2, []), (3, [3 + 0x41, 13])], "k long, pieces array<int>")
    got = {r["k"]: r["decoded"] for r in segment.decode(lists).collect()}
    assert got[1] is None and got[2] == "" and got[3] is not None
    assert {r["k"]: r["decoded"] for r in segment.decode(lists.filter("k = 3").withColumn("pieces", F.array(F.lit(3 + 0xE9)))).collect()} == {3: "\ufffd"}


def test_segmentation_is_seeded_by_key(small):
    a = {r["doc_id"]: r["pieces"] for r in segment.encode(small).collect()}
    b = {r["doc_id"]: r["pieces"] for r in segment.encode(small.repartition(5), seed=0).collect()}
    c = {r["doc_id"]: r["pieces"] for r in segment.encode(small, seed=1).collect()}
    assert a == b and a != c


def test_samples_follow_the_lattice_weights(vocabulary):
    word, n = "therein", 40_000
    spell = {b.decode(): i for i, b in enumerate(vocabulary.bytes_of) if i > 258 and b}

    def every(t):
        if not t:
            yield ()
        for j in range(1, len(t) + 1):
            if t[:j] in spell:
                yield from ((spell[t[:j]], *r) for r in every(t[j:]))

    weight = {s: math.exp(sum(vocabulary.weight[list(s)])) for s in every(word)}
    total = sum(weight.values())
    ids, offs = segment.Lattices(vocabulary).sample([word] * n, blocks.mix(np.arange(n).astype(np.uint64)))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(offs))
    assert set(seen) <= set(weight)
    for s, w in weight.items():
        p = w / total
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


@pytest.mark.parametrize("text", ["    if", "a   b", " {\r\n  x", "();\r\n\r\n", " \r\r", "\t  \n"])
def test_samples_follow_the_whole_lattice_of_blanks(vocabulary, text):
    """Indentation, tables and CRLF: pieces of several blanks and with a carriage return, over the whole text."""
    n = 40_000
    spell = {b.decode(): (i,) for i, b in enumerate(vocabulary.bytes_of) if i > 258 and b}
    cost = {(i,): vocabulary.weight[i] for (i,) in spell.values()}
    for c in set(text) - set(spell):
        spell[c] = tuple(vocabulary.byte[b] for b in c.encode())
        cost[spell[c]] = len(spell[c]) * vocabulary.byte_weight

    def every(t):
        if not t:
            yield (), 0.0
        for j in range(1, len(t) + 1):
            if t[:j] in spell:
                yield from ((spell[t[:j]] + r, cost[spell[t[:j]]] + w) for r, w in every(t[j:]))

    weight = {s: math.exp(w) for s, w in every(text)}
    total = sum(weight.values())
    ids, offs = segment.Lattices(vocabulary).sample([text] * n, blocks.mix(np.arange(n).astype(np.uint64)))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(offs))
    assert set(seen) <= set(weight) and len(weight) > 1
    for s, w in weight.items():
        p = w / total
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


@pytest.mark.parametrize("token", [" " * 300, "x" * 150 + "é漢▁" * 20, "therein" * 28, "\t" * 120 + "y", " " * 37 + "word"])
def test_long_pre_tokens_are_drawn_like_short_ones(vocabulary, monkeypatch, token):
    """The same lattice and draws, filtered in stretches of any length or in one table."""
    keys = blocks.mix(np.arange(50).astype(np.uint64))
    monkeypatch.setattr(segment, "LONG", 10**6)
    want, offs = segment.Lattices(vocabulary).sample([token] * 50, keys)
    for stretch in (16, 50, 4096):
        monkeypatch.setattr(segment, "LONG", 5)
        monkeypatch.setattr(segment, "STRETCH", stretch)
        got, at = segment.Lattices(vocabulary).sample([token] * 50, keys)
        assert got.tolist() == want.tolist() and at.tolist() == offs.tolist()


def test_unbroken_texts_of_millions_of_characters(spark):
    """Runs of blanks and texts without one: memory of the worker stays near that of the text."""
    import resource
    lattices = segment.Lattices(segment.Vocabulary(open(segment.model_path(), "rb").read()))
    for text in (" " * 5_000_000, "therein漢" * 150_000):
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        ids, offs = lattices.sample([text], np.array([3], np.uint64))
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB
        assert lattices.v.decode(ids, offs).to_pylist() == [text]
    docs = spark.createDataFrame([(1, "a" + " " * 300_000 + "b"), (2, "c" * 100_000 + " ")], "doc_id long, text string")
    assert all(r["lossless"] for r in segment.round_trip(docs).collect())


def test_no_piece_crosses_a_cut(vocabulary):
    spelled = [b.decode() for i, b in enumerate(vocabulary.bytes_of) if i > 258 and b]
    assert all(vocabulary.pre_token.findall(p) == [p] for p in spelled)
    assert segment.pre_tokens(["a", " b"]).findall("a  b\r\n") == ["a", " ", " b", "\r", "\n"]


def slow_bits(train, text):
    """Code length by the definition, one byte at a time."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        raw = b"\0\0\0" + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                counts[k][raw[i - k:i]][raw[i]] += 1
    raw, bits = b"\0\0\0" + text.encode(), 0.0
    for i in range(3, len(raw)):
        for k in (3, 2, 1, 0):
            seen = counts[k].get(raw[i - k:i])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_ppm_code_lengths(spark):
    train = {"en": ["the cat sat", "then the hat"], "fr": ["été là", "le chat noir", ""], "xx": ["zzzz"]}
    rows = spark.createDataFrame([(k, t) for k, ts in train.items() for t in ts] + [(None, "no"), ("en", None)], "lang string, text string")
    model = language_id.train(rows)
    texts = ["the chat", "", "été noir zz", "\0\0 q", "le hat " * 50]
    got = model.code_lengths(*blocks.text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.langs):
            assert got[i, k] == pytest.approx(slow_bits(train[lang], t), rel=1e-5, abs=1e-4)


def test_many_languages_are_sharded(spark):
    """200 languages of a few grams each: the model is over its bound as a whole, and every language is told apart."""
    docs = spark.createDataFrame([(k, f"l{k}", f"{chr(0x4E00 + 7 * k)}{chr(0x5E00 + 5 * k)} " * 6) for k in range(200)], "doc_id long, lang string, text string")
    whole = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, F.lit(True)).collect()}
    split = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, F.lit(True), max_entries=20_000).collect()}
    assert whole == split == {k: f"l{k}" for k in range(200)}


def test_language_of_documents(edge, empty, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = crc32_of_id(F.col("doc_id")) % 3
    rows = language_id.identify(docs, learn=fold != 1).join(docs.select("doc_id", "lang"), "doc_id").filter(fold == 1).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(edge.withColumn("score", F.lit("x")), learn=F.lit(True)).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[6][0] in ("en", "fr", "de")
    assert language_id.identify(empty, learn=F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(edge, learn=F.lit(False)).collect()} == {"und"}
    clash = language_id.predict(edge.withColumn("score", F.lit("x")), None)
    assert clash.columns == [*edge.columns, "bits_per_byte", "lang_pred", "score"]


def test_large_models_keep_all_counts(spark, edge, small):
    """A language over max_entries loses no count, and none is lost."""
    odd = spark.createDataFrame([(10**6, "xx", "zzzz"), (10**6 + 1, "yy", "q\0 漢字 é"), (10**6 + 2, None, "Это не учили, это не учили")], "doc_id long, lang string, text string")
    for docs, limits in ((edge, (4, 300)), (small.select("doc_id", "lang", "text").unionByName(odd), (40, 4000))):
        learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
        by = lambda r: (r["doc_id"] is None, r["doc_id"], r["bits_per_byte"])
        want = sorted(language_id.identify(docs, learn).collect(), key=by)
        for limit in limits:
            got = sorted(language_id.identify(docs, learn, max_entries=limit).collect(), key=by)
            assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(r["doc_id"], r["lang_pred"]) for r in want]
            for a, b in zip(got, want):
                assert a["bits_per_byte"] == pytest.approx(b["bits_per_byte"], rel=1e-9) and a["score"] == pytest.approx(b["score"], rel=1e-6)


def test_crc_of_ids(spark):
    assert [r[0] for r in spark.range(20).select(crc32_of_id(F.col("id"))).collect()] == [zlib.crc32(str(i).encode()) for i in range(20)]


def test_quality_scores(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fold = crc32_of_id(F.col("doc_id")) % 5
    got = quality_classifier.fit_and_score(docs, labels, "quality", fold.isin(1, 2, 3), fold == 4)
    rows = got.join(labels, "doc_id").filter(fold == 0).collect()
    assert got.count() == docs.count()
    right = [(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]
    assert sum(right) / len(right) > 0.97
    bad = [r["score"] < 0.3 for r in rows if r["quality"] == 0]
    assert sum(bad) / len(bad) > 0.9
    some = spark.createDataFrame([(3, 1), (7, 0), (9, 1), (9, 0), (None, 1), (11, None), (12, 1), (999, 0)], "doc_id long, quality int")
    out = quality_classifier.fit_and_score(edge, some, "quality", F.lit(True), F.lit(True)).collect()
    assert len(out) == edge.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality_classifier.fit_and_score(edge, some.limit(0), "quality", F.lit(True), F.lit(True)).collect()} == {0.5}
    assert quality_classifier.fit_and_score(empty, some, "quality", F.lit(True), F.lit(True)).count() == 0


def test_normal_equations_sum_over_partitions(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((300, quality_classifier.STATS)).astype(np.float32), rng.random(300)
    kernel = quality_classifier.Kernel(np.zeros(quality_classifier.STATS), np.ones(quality_classifier.STATS), 20, 3.0, 1)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "stats array<float>, y double").repartition(7)
    a, b, n = quality_classifier.normal_equations(df, kernel)
    f = kernel(x.astype(float))
    assert n == 300 and np.allclose(a, f.T @ f) and np.allclose(b, f.T @ y)


def test_random_features_approach_the_gaussian_kernel():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, quality_classifier.STATS))
    k = quality_classifier.Kernel(np.zeros(x.shape[1]), np.ones(x.shape[1]), 20_000, 4.0, 3)
    f = k(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * 16))
    assert np.abs(f @ f.T - want).max() < 0.05


def test_isotonic_pools_violators():
    x, v = quality_classifier.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 0.8, 0.2, 1.0]), np.array([1.0, 1, 3, 1]))
    assert x.tolist() == [0, 1.75, 3] and v.tolist() == pytest.approx([0, 0.35, 1])


def test_block_words_and_hashes():
    texts = ["", None, " a\tbb\n", "x" * 30 + " y", "\x0b", "é b", "b"]
    data, offs = blocks.text_bytes(pa.array(texts))
    s, e, first = blocks.words(data, offs)
    got = [[bytes(data[a:b]).decode() for a, b in zip(s[i:j], e[i:j])] for i, j in itertools.pairwise(first)]
    assert got == [(t or "").split() for t in texts]
    h = dict()
    for w, x in zip([w for ws in got for w in ws], blocks.word_hashes(data, s, e).tolist()):
        assert h.setdefault(w, x) == x
    assert len(set(h.values())) == len(h)
    table = blocks.IntTable(np.arange(0, 9000, 3))
    assert table.find(np.arange(9003)).tolist() == [i // 3 if i % 3 == 0 and i < 9000 else -1 for i in range(9003)]
    assert blocks.IntTable(np.zeros(0, int)).find(np.array([1])).tolist() == [-1]

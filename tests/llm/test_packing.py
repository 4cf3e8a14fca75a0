"""Packing against a sequential deficit round-robin."""
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import packing


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def plain_stream(rows, library, window, packet, weight):
    """The stream of (source, doc_id, tokens) as the rounds go, packet by packet, with whole-number deficits."""
    queues = defaultdict(list)
    for r in rows:
        queues[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, ids_of(library, r["text"])))
    order = sorted(queues, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:  # narrow ids are stored as two bytes: their crc orders rows of one id
        queues[s].sort(key=lambda q: (q[0], q[1], zlib.crc32(np.array(q[2], "<u2").tobytes())))
    sizes = {s: sum(len(q[2]) for q in queues[s]) for s in order}
    weights = {s: weight(s, sizes[s]) for s in order}
    whole = sum(weights.values())
    packets = {s: [(q[1] if q[0] else None, q[2][k:k + packet]) for q in queues[s] for k in range(0, len(q[2]), packet)] for s in order}
    deficit, out = dict.fromkeys(order, 0), []
    while any(packets.values()):
        for s in order:
            deficit[s] += window * weights[s]  # in units of 1 / whole
            while packets[s] and len(packets[s][0][1]) * whole <= deficit[s]:
                doc, ids = packets[s].pop(0)
                deficit[s] -= len(ids) * whole
                out += [(s, doc, t) for t in ids]
    return out


def check(rows, pieces, library, length):
    """Pieces cover each row's ids once, places are gapless, sequences are full or a power of two; the stream they make."""
    left = defaultdict(list)
    for r in rows:
        left[r["doc_id"], r["source"]].append(ids_of(library, r["text"]))
    places = defaultdict(list)
    for p in pieces:
        places[p["sequence_id"]].append(p)
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] and crc(ids) == p["ids_crc32"]
    for key, texts in left.items():
        mine = sorted((p["start"], p["start"] + p["length"], p["doc_tokens"], tuple(np.frombuffer(p["ids"], "<u4").tolist()))
                      for p in pieces if (p["doc_id"], p["source"]) == key)
        assert sum(b - a for a, b, _, _ in mine) == sum(map(len, texts))
        if len(texts) == 1:
            assert [a for a, *_ in mine] == [0, *[b for _, b, _, _ in mine]][:-1] and all(n == len(texts[0]) for _, _, n, _ in mine)
            assert [t for *_, ids in mine for t in ids] == texts[0]
    assert sorted(places) == list(range(len(places)))
    stream = []
    for k in sorted(places):
        at = 0
        for p in sorted(places[k], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
            stream += [(p["source"], p["doc_id"], t) for t in np.frombuffer(p["ids"], "<u4").tolist()]
        assert at == length or at < length and at & (at - 1) == 0 and k >= len(places) - length.bit_length()
    return stream


@pytest.mark.parametrize("name", ["edge", "small"])
@pytest.mark.parametrize("length,window,packet,weight", [(2048, 32768, 256, None), (64, 300, 7, None), (128, 1000, 50, "even")])
def test_stream_is_that_of_the_rounds(request, library, name, length, window, packet, weight):
    docs = request.getfixturevalue(name)
    rows = docs.collect()
    got = packing.pack(docs, length, window, packet, weight and F.lit(1), ids=True).collect()
    stream = check(rows, got, library, length)
    assert stream == plain_stream(rows, library, window, packet, (lambda s, n: 1) if weight else (lambda s, n: n))


def test_windows_keep_the_targets(small):
    """After any round each source is less than one packet behind its target."""
    rows = packing.pack(small, packet=64).collect()
    sizes, sent = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["length"]
    total = sum(sizes.values())
    by = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by[r["round"]][r["source"]] += r["length"]
    for k in sorted(by):
        for s in sizes:
            sent[s] += by[k][s]
            due = min((k + 1) * packing.WINDOW * sizes[s] / total, sizes[s])
            assert -1e-6 < due - sent[s] < 64 + 1e-6
    assert sent == sizes


def test_sequences_hold_the_ids(small, library):
    pieces = packing.pack(small, ids=True)
    rows = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    total = sum(len(ids_of(library, r["text"])) for r in small.collect())
    assert sum(r["n_tokens"] for r in rows.values()) == total
    assert all(len(r["ids"]) == r["n_tokens"] for r in rows.values())  # no padding at all
    for p in pieces.collect():
        assert rows[p["sequence_id"]]["ids"][p["offset"]:p["offset"] + p["length"]] == np.frombuffer(p["ids"], "<u4").tolist()
    shares = packing.mixture(pieces).collect()
    assert sum(r["tokens"] for r in shares) == total


def test_ids_are_those_of_the_library(library):
    tok = packing.Tokenizer(open(packing.tokenizer_path(), "rb").read(), packing.byte_pattern())
    texts = ["", "a <|endoftext|> b<|endoftext|><|endof", "é ß 中文 ▁ ​ \r\n\t  x\x00y � 😀 don't I'LL", "\n\n\n  x", " " * 100_000, "\n" * 100_000, " " * 3_000_000, "a" * 300_000, " \x85\xa0　x"]
    for t in texts:
        assert tok.ids(t) == library.encode(t, add_special_tokens=False).ids


def test_a_long_text_and_clashing_columns(spark, library):
    """One text of a million words among small ones; columns named like those made on the way."""
    long = " ".join(f"w{k % 977}" for k in range(1_000_000))
    docs = spark.createDataFrame([(1, long, "a"), (2, "short", "b"), (3, None, "b"), (4, "x y", None)], "doc_id long, text string, source string")
    odd = docs.withColumns({c: F.lit("x") for c in ("row", "n", "ids", "wide", "crc", "name", "offset", "start", "length", "round", "weight")})
    check(docs.collect(), packing.pack(odd, ids=True).collect(), library, 2048)


def test_empty_table(empty):
    assert packing.pack(empty).count() == 0 and packing.sequences(packing.pack(empty, ids=True)).count() == 0

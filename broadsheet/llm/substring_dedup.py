"""Substring deduplication: removes long word runs that an earlier document already has.

A window is ``window`` consecutive words of one document.  A word goes if a
window covers it whose words also begin somewhere in a document with a smaller
id; windows are judged on the input.

Equal windows must meet without shuffling every window:

1. The anchor of a window is the smallest hash among its ``GRAM``-word grams,
   so neighbouring windows mostly share one.  Tasks emit each anchor once per
   batch with the smallest and largest id that has it; sorted by anchor, those
   seen in two documents are found in a stream.
2. Runs of windows with such an anchor are cut out as segments and dealt to
   shards by anchor; equal windows have equal anchors, so they meet there.
   Within a bucket of documents equal segments travel once, with the places
   that have them: all but those of the smallest id are known duplicates.
   An anchor that is in more than ``HOT`` segments is not routed as one: each
   of its windows is dealt by the hash of all its words, with the places of the
   bucket's smallest id only (the others are duplicates already), so what a
   window sends is one row a bucket however many documents have it.
3. Each shard builds a compressed FM-index of its different segments and
   streams them against it: backward search gives, per window, the interval of
   all its occurrences, and the smallest id in it decides.
4. The removed ranges go back to the bucket of their document.

Hashes only route; a shard compares words by their bytes.  Texts are shuffled
once: the three steps that need them read the same exchange.

Defined cases: null and empty texts have no words and hash as the empty
string; rows without an id neither lose words nor count as earlier; rows that
repeat an id do not remove from each other (no id is smaller); an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.blocks import gram_hashes, mix, slices, take_ranges, text_bytes, word_hashes, words
from broadsheet.llm.common import partitions
from broadsheet.llm.fm_index import FMIndex

WINDOW = 13
GRAM = 6
BUCKET_BYTES = 8 << 20
LONGEST = 64  # windows of a segment
HOT = 512  # segments; windows of an anchor in more are routed one by one


def window_anchors(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, anchor) of every window; ``h``: word hashes, ``first``: first word of each text."""
    g, n = gram_hashes(h, gram), window - gram + 1
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.flatnonzero(np.arange(len(h)) + window <= first[1:][of]) if len(h) else np.zeros(0, np.int64)
    if not begin.size:
        return begin, begin, np.zeros(0, np.int64)
    low, size = g, 1
    while 2 * size <= n:
        low = np.minimum(low[:len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[begin], low[begin + n - size])
    return begin, of[begin], low.view(np.int64)


def _run_heads(begin: np.ndarray, of: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether a window is not the next one of its text with the same anchor."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (of[1:] != of[:-1]) | (begin[1:] != begin[:-1] + 1)
    return new


def _anchors(window: int, gram: int):
    def task(batches):
        for b in slices(batches, "text"):
            b = b.filter(pc.is_valid(b.column("doc_id")))
            s, e, first = words(*(x := text_bytes(b.column("text"))))
            begin, of, a = window_anchors(word_hashes(x[0], s, e), first, window, gram)
            if not len(a):
                continue
            doc, bucket = b.column("doc_id").to_numpy()[of], b.column("bucket").to_numpy()[of]
            new = _run_heads(begin, of, a)
            order = np.lexsort((bucket, a))
            a, bucket, doc = a[order], bucket[order], doc[order]
            head = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (bucket[1:] != bucket[:-1])) + 1])
            lo, hi = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
            n = np.add.reduceat(new[order], head, dtype=np.int32)
            # hi is mostly lo again and n mostly 1: null then, which takes no room in the shuffle
            yield pa.RecordBatch.from_arrays([pa.array(a[head]), pa.array(bucket[head]), pa.array(lo), pa.array(hi, mask=hi == lo), pa.array(n, mask=n == 1)],
                                             ["a", "bucket", "lo", "hi", "n"])
    return task


def _shared(most: int):
    """(a, bucket, hot) of the anchors that two documents have; hot: in more than ``most`` segments.  Rows come sorted by anchor."""
    def found(c):
        head = np.concatenate([[0], np.flatnonzero(c[0][1:] != c[0][:-1]) + 1])
        size = np.diff(np.append(head, len(c[0])))
        several = np.minimum.reduceat(c[2], head) < np.maximum.reduceat(c[3], head)
        hot = np.add.reduceat(c[4].astype(np.int64), head) > most
        keep = np.repeat(several, size)
        rows = np.stack([c[0], c[1].astype(np.int64), np.repeat(hot, size)])[:, keep]
        rows = rows[:, np.lexsort(rows[1::-1])]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        a, bucket, hot = rows[:, new]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(bucket.astype(np.int32)), pa.array(hot.astype(bool))], ["a", "bucket", "hot"])

    def task(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns[:3]] + [pc.coalesce(b.column("hi"), b.column("lo")).to_numpy(), pc.fill_null(b.column("n"), 1).to_numpy()]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield found([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None:
            yield found(held)
    return task


def _parts(table: pa.Table):
    """Batches of a table in slices of a few megabytes of text."""
    return slices(iter(table.combine_chunks().to_batches()), "text")


def _versions(docs: pa.Table) -> np.ndarray:
    """Per row, the rank of its text's hash among the texts of its id (0 unless an id is repeated)."""
    doc = docs.column("doc_id").combine_chunks().fill_null(0).to_numpy()
    th = docs.column("th").to_numpy()
    order = np.lexsort((th, doc))
    doc, th = doc[order], th[order]
    step = np.zeros(len(doc), np.int64)
    step[1:] = (doc[1:] == doc[:-1]) & (th[1:] != th[:-1])
    total = np.cumsum(step)
    head = np.ones(len(doc), bool)
    head[1:] = doc[1:] != doc[:-1]
    out = np.empty(len(doc), np.int64)
    out[order] = total - total[np.flatnonzero(head)][np.cumsum(head) - 1] if len(doc) else total
    return out


def _segments(window: int, gram: int, shards: int):
    """Rows (shard, bucket, segment, places): places are triples (doc_id, version, first word), smallest id first.

    A row without a segment has known duplicates: (doc_id, version, first word, word behind the last) each.
    """
    names = ["shard", "bucket", "segment", "places"]

    def cut(key, shared: pa.Table, docs: pa.Table) -> pa.Table:
        wanted, busy = shared.column("a").to_numpy(), shared.column("hot").to_numpy()
        order = np.argsort(wanted)
        wanted, busy = wanted[order], busy[order]
        bucket = key[0].as_py()
        text, route, hot, doc, version, start = [], [], [], [], [], []
        docs = docs.append_column("version", pa.array(_versions(docs)))
        for b in _parts(docs) if len(wanted) else ():
            b = b.filter(pc.is_valid(b.column("doc_id")))
            data, offs = text_bytes(b.column("text"))
            s, e, first = words(data, offs)
            h = word_hashes(data, s, e)
            begin, of, a = window_anchors(h, first, window, gram)
            at = np.minimum(np.searchsorted(wanted, a), len(wanted) - 1)
            hit = wanted[at] == a
            begin, of, a, alone = begin[hit], of[hit], a[hit], busy[at[hit]]
            if not len(a):
                continue
            new = _run_heads(begin, of, a) | alone
            run = np.flatnonzero(new)[np.cumsum(new) - 1]
            head = np.flatnonzero((np.arange(len(a)) - run) % LONGEST == 0)
            tail = np.append(head[1:], len(a)) - 1
            # words with one blank behind each, so a segment is one range of bytes
            plain, po = take_ranges(data, s, e + 1)
            plain[po[1:] - 1] = 32
            w0, w1 = begin[head], begin[tail] + window
            raw, ro = take_ranges(plain, po[w0], po[w1] - 1)
            text.append(pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ro.astype(np.int32)), pa.py_buffer(raw)]))
            by = a[head].view(np.uint64)
            if alone.any():
                by = np.where(alone[head], gram_hashes(h, window)[w0], by)
            route.append(by)
            hot.append(alone[head])
            doc.append(b.column("doc_id").to_numpy()[of[head]])
            version.append(b.column("version").to_numpy()[of[head]])
            start.append(w0 - first[of[head]])
        if not text:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())])})
        spelled = pa.concat_arrays(text).dictionary_encode()
        route, hot, doc, version, start = (np.concatenate(x) for x in (route, hot, doc, version, start))
        kind = spelled.indices.to_numpy()
        order = np.lexsort((start, version, doc, kind))
        head = np.concatenate([[0], np.flatnonzero(np.diff(kind[order])) + 1])
        least = np.repeat(doc[order[head]], np.diff(np.append(head, len(order))))
        known = hot[order] & (doc[order] > least)
        late, order = order[known], order[~known]
        head = np.concatenate([[0], np.flatnonzero(np.diff(kind[order])) + 1])
        offs = pa.array(3 * np.append(head, len(order)), pa.int32())
        places = pa.ListArray.from_arrays(offs, pa.array(np.stack([doc, version, start], axis=1)[order].ravel()))
        shard = (mix(route[order[head]]) % np.uint64(shards)).astype(np.int32)
        out = pa.table([pa.array(shard), pa.array(np.full(len(head), bucket, np.int32)), spelled.dictionary.take(pa.array(kind[order[head]])), places], names)
        if not late.size:
            return out
        late = late[np.lexsort((start[late], version[late], doc[late]))]
        d, v, w = doc[late], version[late], start[late]
        head = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (w[1:] > w[:-1] + window)) + 1])
        tail = np.append(head[1:], len(late)) - 1
        ranges = np.stack([d[head], v[head], w[head], w[tail] + window], axis=1).ravel()
        ready = [pa.array([x], f.type) for x, f in zip((bucket % shards, bucket, None, ranges), out.schema)]
        return pa.concat_tables([out, pa.table(ready, out.schema)])

    return cut


def word_numbers(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Equal words, and only those, get equal numbers (from 1): by hash, checked by their bytes."""
    _, at, number = np.unique(word_hashes(data, s, e), return_index=True, return_inverse=True)
    mine, mo = take_ranges(data, s, e)
    if (e - s == (e - s)[at][number]).all() and (mine == take_ranges(data, s[at][number], e[at][number])[0]).all():
        return number.astype(np.int64) + 1
    seen: dict[bytes, int] = {}
    raw = mine.tobytes()
    return np.array([seen.setdefault(raw[a:b], len(seen) + 1) for a, b in zip(mo, mo[1:])], np.int64)


def duplicate_ranges(segments: pa.Array, lists: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, from, to): word ranges to remove, by the place they are in.

    The places lists[i]:lists[i + 1], with their documents and first words, hold segment i.
    """
    coded = segments.dictionary_encode()
    kind = coded.indices.to_numpy()
    leader = doc[lists[:-1]]
    least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, leader)
    data, offs = text_bytes_of(coded.dictionary)
    s, e, first = words(data, offs)
    count = np.diff(first)
    # the segments one after the other, each with a 0 behind it
    begin = first[:-1] + np.arange(len(count))
    seq = np.zeros(len(s) + len(count), np.int64)
    seq[np.arange(len(s)) + np.repeat(np.arange(len(count)), count)] = word_numbers(data, s, e)
    index = FMIndex(seq, window)
    lo, hi = index.matches(begin, begin + count)
    owner = np.repeat(least, count + 1)[index.order]
    at = np.flatnonzero(hi > lo)
    left, where = np.unique(lo[at], return_inverse=True)
    right = hi[at][np.unique(lo[at], return_index=True)[1]]
    edges = np.stack([left, right], axis=1).ravel()
    earliest = np.full(len(seq), np.iinfo(np.int64).max)
    # intervals are disjoint: every second range of the edges is one of them
    earliest[at] = np.minimum.reduceat(np.append(owner, np.iinfo(np.int64).max), edges)[::2][where]
    row = np.repeat(np.arange(len(kind)), np.diff(lists))
    windows = count[kind] - window + 1
    place = np.arange(len(doc))
    later = doc > leader[row]  # the leader has the whole segment
    whole = place[later]
    first_ones = place[~later]
    n = windows[row[first_ones]]
    flat = np.repeat(first_ones, n)
    j = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    gone = earliest[begin[kind[row[flat]]] + j] < doc[flat]
    on = np.flatnonzero(gone)
    if on.size:
        new = np.ones(len(on), bool)
        new[1:] = (on[1:] != on[:-1] + 1) | (flat[on][1:] != flat[on][:-1])
        a = on[new]
        z = on[np.append(np.flatnonzero(new)[1:], len(on)) - 1]
    else:
        a = z = on
    where = np.concatenate([whole, flat[a]])
    begins = np.concatenate([start[whole], start[flat[a]] + j[a]])
    ends = np.concatenate([start[whole] + count[kind[row[whole]]], start[flat[a]] + j[z] + window])
    return where, begins, ends


def text_bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """text_bytes of a binary column."""
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), offs - offs[0]


def _search(window: int):
    def rows(bucket, doc, version, a, z) -> pa.Table:
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "version": pa.array(version, pa.int64()),
                         "begin": pa.array(a, pa.int64()), "end": pa.array(z, pa.int64())})

    def unpacked(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
        places = table.column("places").combine_chunks()
        size = pc.list_value_length(places).to_numpy(zero_copy_only=False) // width
        return np.concatenate([[0], np.cumsum(size)]).astype(np.int64), places.flatten().to_numpy().reshape(-1, width).T

    def shard(table: pa.Table) -> pa.Table:
        ready = pc.is_null(table.column("segment"))
        known, table = table.filter(ready).combine_chunks(), table.filter(pc.invert(ready)).combine_chunks()
        out = []
        if known.num_rows:
            lists, ranges = unpacked(known, 4)
            out.append(rows(np.repeat(known.column("bucket").to_numpy(), np.diff(lists)), *ranges))
        if table.num_rows:
            lists, (doc, version, start) = unpacked(table, 3)
            where, a, z = duplicate_ranges(table.column("segment").combine_chunks().cast(pa.binary()), lists, doc, start, window)
            row = np.repeat(np.arange(table.num_rows), np.diff(lists))
            out.append(rows(table.column("bucket").to_numpy()[row[where]], doc[where], version[where], a, z))
        return pa.concat_tables(out)
    return shard


def _finish(texts: bool):
    def cut(ranges: pa.Table, docs: pa.Table) -> pa.Table:
        by: dict[tuple, list] = {}
        for key in zip(*(ranges.column(c).to_pylist() for c in ("doc_id", "version", "begin", "end"))):
            by.setdefault(key[:2], []).append(key[2:])
        out = []
        docs = docs.append_column("version", pa.array(_versions(docs)))
        for b in _parts(docs):
            data, offs = text_bytes(b.column("text"))
            s, e, first = words(data, offs)
            step = np.zeros(len(s) + 1, np.int64)
            ids = b.column("doc_id").to_pylist()
            for i, key in enumerate(zip(ids, b.column("version").to_pylist())):
                for a, z in by.get(key, ()):
                    step[first[i] + a] += 1
                    step[first[i] + z] -= 1
            keep = np.cumsum(step[:-1]) == 0
            plain, po = take_ranges(data, s[keep], e[keep] + 1)
            plain[po[1:] - 1] = 32
            left = np.concatenate([[0], np.cumsum(keep)])[first]
            raw, at = plain.tobytes(), po[left]
            kept = [raw[x:max(x, y - 1)] for x, y in zip(at, at[1:])]
            n = np.diff(first)
            cols = {"doc_id": b.column("doc_id"), "n_words": n, "n_removed": n - np.diff(left)}
            if texts:
                cols["kept"] = pa.array([k.decode() for k in kept], pa.string())
            out.append(pa.table(cols | {"kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}))
        return pa.concat_tables(out)
    return cut


def _dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, th, bucket) in the partition of its bucket, and the number of buckets."""
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), total // BUCKET_BYTES + 1)
    dealt = docs.select("doc_id", "text", th.alias("th"), F.pmod(F.xxhash64("doc_id", th), F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.repartition(buckets, "bucket"), buckets


def routed(dealt: DataFrame, buckets: int, window: int, gram: int, hot: int) -> DataFrame:
    """Rows (shard, bucket, segment, places) of what two documents may share."""
    seen = dealt.mapInArrow(_anchors(window, gram), "a long, bucket int, lo long, hi long, n int")
    shared = seen.repartition(buckets, "a").sortWithinPartitions("a").mapInArrow(_shared(hot), "a long, bucket int, hot boolean")
    return shared.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(
        _segments(window, gram, buckets), "shard int, bucket int, segment binary, places array<long>")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs``; with ``texts`` also ``kept``, the words left."""
    dealt, buckets = _dealt(docs)
    # as many tasks as buckets: a task holds about one shard at any size of the corpus
    segments = routed(dealt, buckets, window, gram, hot).repartition(buckets, "shard")
    ranges = segments.groupBy("shard").applyInArrow(_search(window), "bucket int, doc_id long, version long, begin long, end long")
    schema = "doc_id long, n_words long, n_removed long, " + "kept string, " * texts + "kept_sha256 string"
    return ranges.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(_finish(texts), schema)

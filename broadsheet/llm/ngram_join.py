"""N-gram Jaccard self-join with PartEnum signatures, and the components of its links.

Texts become sets of word n-grams; two link when their Jaccard similarity is at
least ``percent`` %.  Such sets have close sizes and a bounded symmetric
difference, so sizes are cut into bands and each band has a bound k on it.
The domain of n-grams is cut into groups, each group into ``SUB`` parts.  With
more than k / 2 groups some group has at most one differing n-gram, and
leaving out the part that holds it the rest of the group is equal in both sets.
A signature is the hash of a group without one part, for every group and part;
a set signs for its own band and the next, so linked sets share a signature.

Steps, none of which collects a group in one place or lists its pairs:

1. Equal sets form classes (partial aggregation); one text of each goes on.
2. Signatures are sorted by value and streamed into member lists, chunked at
   ``CHUNK`` members; equal lists are kept once.
3. Members hang together in blocks.  A block of at most ``BLOCK`` members is
   compared by one task.  In a larger one all lists of one hub (smallest
   member) are a task, or, if they are too many, each list for itself, every
   pair of its chunks being a task.
4. Tasks first compare sketches, one to two bits an n-gram (``sketches``): they
   leave out pairs that cannot link, most of those that share boilerplate only.
   What hangs together by the others is a task, and its texts are sent once; only
   where more than ``BLOCK`` sets do, each task of step 3 is cut by them.
5. These tasks compute exact similarities by counting common n-grams and return
   spanning links only.
6. Links and class memberships give the components.

Signatures of empty projections are left out where enough groups are full to
guarantee a full one in common, and kept otherwise, so no link is lost.

Defined cases: null, empty and blank texts have empty sets and link with
nothing; fewer than n words count as one n-gram; rows that repeat an id are one
node of the graph, each with its own set; rows without an id are not linked and
have component null; an empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.blocks import C1, gram_hashes, mix, power, slices, text_bytes, word_hashes, words
from broadsheet.llm.common import connected, lookup, partitions, small
from broadsheet.session import cut_lineage, free_shuffles

SUB = 2  # parts of a group
SPARE = 1.15  # groups over the least number, so that empty parts do no harm
CHUNK = 1000
BLOCK = 2000
COLUMNS = 8192


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the set of n-gram hashes of each text, ascending; A-Z count as a-z."""
    data, offs = text_bytes(column)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    s, e, first = words(data, offs)
    h, count = word_hashes(data, s, e), np.diff(first)
    of = np.repeat(np.arange(len(count)), count)
    grams = gram_hashes(h, n)
    whole = np.flatnonzero(np.arange(len(grams)) + n <= first[1:][of[:len(grams)]]) if len(grams) else np.zeros(0, int)
    parts, owner = [grams[whole]], [of[whole]]
    for m in range(1, n):  # texts of fewer than n words
        short = np.flatnonzero(count == m)
        if short.size:
            total = np.zeros(len(short), np.uint64)
            for k in range(m):
                total += h[first[short] + k] * power(k)
            parts.append(mix(total ^ np.uint64(m)))
            owner.append(short)
    value, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.argsort(value)
    small = np.uint16 if len(count) < 1 << 16 else np.int64  # 16 bits are sorted by radix
    order = order[np.argsort(owner[order].astype(small), kind="stable")]
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(count)))]).astype(np.int64)


def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size, last size) of the bands; linked sets are in one band or in neighbours."""
    low, high = [1], []
    while low[-1] < 1 << 40:
        high.append(low[-1] * 100 // percent)
        low.append(high[-1] + 1)
    return np.array(low[:-1]), np.array(high)


def signatures(value: np.ndarray, offs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, own) of every set for its own band (``own``) and the next."""
    low, high = bands(percent)
    size = np.diff(offs)
    of = np.repeat(np.arange(len(size)), size)
    code, place = mix(value ^ C1), mix(value + C1)
    band = np.searchsorted(low, size, "right") - 1
    out, who, own = [], [], []
    for step in (0, 1):
        at = np.maximum(band, 0) + step
        k = np.where(size > 0, 2 * high[at] * (100 - percent) // (100 + percent), 0)
        groups = np.where(k > 0, np.ceil(SPARE * (k // 2 + 1)).astype(np.int64), 0)
        base = np.concatenate([[0], np.cumsum(groups)])
        on = np.flatnonzero(groups[of] > 0)
        if not on.size:
            continue
        slot = (base[of[on]] * SUB + (place[on] % (groups[of[on]] * SUB).astype(np.uint64)).astype(np.int64))
        n = int(base[-1])
        total, filled = np.zeros(n * SUB, np.uint64), np.bincount(slot, minlength=n * SUB).reshape(n, SUB)
        np.add.at(total, slot, code[on])
        total = total.reshape(n, SUB)
        rest, left = total.sum(axis=1, keepdims=True) - total, filled.sum(axis=1, keepdims=True) - filled
        text = np.repeat(np.arange(len(size)), groups)
        number = np.arange(n) - np.repeat(base[:-1], groups)
        name = (at[text] * (1 << 40) + number).astype(np.uint64)[:, None] * np.uint64(SUB) + np.arange(SUB).astype(np.uint64)
        full = (left > 0).all(axis=1)
        enough = np.bincount(text, full, len(size)) >= k // 2 + 1
        keep = (left > 0) | ~enough[text][:, None]
        out.append(mix(rest ^ mix(name))[keep])
        who.append(np.repeat(text, SUB).reshape(n, SUB)[keep])
        own.append(np.full(len(who[-1]), step == 0))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(out), np.concatenate(who), np.concatenate(own)


def sketches(value: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of 64 bits, offsets): per set, the parities of its counts in as many cells as the next power of two.

    Two sets differ in at least as many n-grams as their parities do in cells.
    The halves of a sketch, one xor the other, are the sketch of half as many cells.
    """
    size = np.diff(offs)
    words = 1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(words)])
    of = np.repeat(np.arange(len(size)), size)
    cell = first[of] * 64 + (mix(value + np.uint64(3)) & (words[of] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(cell, minlength=first[-1] * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64), first


def possible(size: np.ndarray, sketch: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets may link: linked sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum."""
    order = np.argsort(size, kind="stable")
    size = size[order].astype(np.int64)
    length, most = np.array([len(sketch[i]) for i in order]), size * 100 // percent  # of a larger set
    may = np.zeros((len(size), len(size)), bool)
    for w in np.unique(length):
        a, b = np.searchsorted(length, w), np.searchsorted(length, w, "right")
        end = np.searchsorted(size, most[b - 1], "right")
        cells = np.stack([np.bitwise_xor.reduce(sketch[i].reshape(-1, w), axis=0) for i in order[a:end]], axis=1)
        for s in range(a, b, 256):
            t = min(s + 256, b)
            e = np.searchsorted(size, most[t - 1], "right")
            low, high = cells[:, s - a:t - a, None], cells[:, None, s - a:e - a]
            apart, step = np.zeros((t - s, e - s), np.int64), max(1, (1 << 18) // ((t - s) * (e - s)))
            for k in range(0, w, step):
                apart += np.bitwise_count(low[k:k + step] ^ high[k:k + step]).sum(axis=0, dtype=np.int64)
            may[s:t, s:e] = (100 + percent) * apart <= (100 - percent) * (size[s:t, None] + size[None, s:e])
    out = np.empty_like(may)
    out[np.ix_(order, order)] = may | may.T
    return out


def described(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, sketch): set size, two independent fingerprints of the set, and its sketch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            value, offs = shingles(b.column("text"), n)
            total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(k)))]) for k in (1, 2)]
            f = [pa.array((t[offs[1:]] - t[offs[:-1]]).view(np.int64)) for t in total]
            cells, first = sketches(value, offs)
            sketch = pa.BinaryArray.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(cells)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offs)), *f, sketch], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def member_lists(docs: DataFrame, n: int, percent: int, most: int = CHUNK) -> DataFrame:
    """(gid, chunk, hub, members): documents that share a signature, in chunks, equal lists once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 21):
            sig, of, own = signatures(*shingles(b.column("text"), n), percent)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), b.column("doc_id").take(pa.array(of)), pa.array(own)], ["sig", "doc", "own"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, doc, own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # rows not yet given out
        hub, name, chunk = None, 0, 0  # of a list too long to wait for its end

        def chunks(size: int, ended: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sig, doc, own, chunk
            while size >= most or (ended and size):
                k = min(size, most)
                yield pa.RecordBatch.from_pydict({"gid": [name], "chunk": pa.array([chunk], pa.int32()), "hub": [hub], "members": [doc[:k].tolist()]})
                sig, doc, own, size, chunk = sig[k:], doc[k:], own[k:], size - k, chunk + 1

        for b in batches:
            sig = np.concatenate([sig, b.column("sig").to_numpy()])
            doc = np.concatenate([doc, b.column("doc").to_numpy()])
            own = np.concatenate([own, b.column("own").to_numpy(zero_copy_only=False)])
            if hub is not None:
                size = int(np.searchsorted(sig, name, "right"))
                ended = size < len(sig)
                yield from chunks(size, ended)
                if ended:
                    hub = None
            if hub is None and len(sig):
                last = int(np.searchsorted(sig, sig[-1]))
                if last:
                    yield from _closed(sig[:last], doc[:last], own[:last], most)
                    sig, doc, own = sig[last:], doc[last:], own[last:]
                if len(sig) > most:
                    hub, name, chunk = int(doc[0]), int(sig[0]), 0
                    yield from chunks(len(sig), False)
        if hub is not None:
            yield from chunks(len(sig), True)
        elif len(sig):
            yield from _closed(sig, doc, own, most)

    signed = docs.select("doc_id", "text").mapInArrow(sign, "sig long, doc long, own boolean")
    dealt = signed.repartition(partitions(docs.sparkSession), "sig").sortWithinPartitions("sig", "doc")
    found = dealt.mapInArrow(lists, "gid long, chunk int, hub long, members array<long>")
    return found.dropDuplicates(["gid", "chunk", "hub"])


def _closed(sig: np.ndarray, doc: np.ndarray, own: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of complete lists: short ones named by their members, long ones (in chunks) by their signature.

    A list without a set of its own band has only pairs that the band below covers.
    """
    head = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1])
    size = np.diff(np.append(head, len(sig)))
    several = (size > 1) & np.logical_or.reduceat(own, head)
    short = several & (size <= most)
    if short.any():
        at = np.flatnonzero(short)
        n = size[at]
        offs = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(offs[-1]) + np.repeat(head[at] - offs[:-1], n)
        code = mix(doc[take].astype(np.uint64) + C1)
        gid = mix(np.add.reduceat(code, offs[:-1]) + n.astype(np.uint64)).view(np.int64)
        members = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(doc[take]))
        yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(np.zeros(len(at), np.int32)), pa.array(doc[head[at]]), members],
                                         ["gid", "chunk", "hub", "members"])
    for i in np.flatnonzero(size > most):
        rows = doc[head[i]:head[i] + size[i]]
        parts = [rows[k:k + most].tolist() for k in range(0, len(rows), most)]
        yield pa.RecordBatch.from_pydict({"gid": [int(sig[head[i]])] * len(parts), "chunk": pa.array(range(len(parts)), pa.int32()),
                                          "hub": [int(rows[0])] * len(parts), "members": parts})


def comparisons(lists: DataFrame, most: int = BLOCK) -> DataFrame:
    """(task, doc): every two members of a list meet in a task of at most ``most`` members, or of two chunks."""
    each = lists.select("gid", "chunk", "hub", F.explode("members").alias("doc"))
    block = cut_lineage(connected(each.select(F.col("hub").alias("u"), F.col("doc").alias("v"))))
    large = block.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("root")
    small = block.join(large, "root", "left_anti").select(F.col("root").alias("task"), F.col("node").alias("doc"))
    crowded = block.join(large, "root").select(F.col("node").alias("hub"))
    rest = cut_lineage(lists.join(crowded, "hub", "left_semi"))
    # in a large block the lists of one hub overlap: together they are a task, if few enough
    around = cut_lineage(rest.select("hub", F.explode("members").alias("doc")).distinct())
    busy = around.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("hub")
    by_hub = around.join(busy, "hub", "left_anti").select(F.xxhash64("hub").alias("task"), "doc")
    rest = rest.join(busy, "hub", "left_semi")
    chunks = rest.groupBy("gid", "hub").agg((F.max("chunk") + 1).alias("chunks"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    meet = rest.join(chunks, ["gid", "hub"]).select("gid", "hub", "chunk", "members", other.alias("other"))
    name = F.xxhash64("gid", "hub", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return small.unionByName(by_hub).unionByName(meet.select(name.alias("task"), F.explode("members").alias("doc")))


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Per set, the smallest id it reaches by links among these sets."""
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    kinds, at, seen = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(seen > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    shared = seen[at] > 1
    row, col = row[shared], column[at[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, [a, a + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, int(col[-1]) + 1 - a)), np.float32)
        m[row[i:j], col[i:j] - a] = 1
        common += m @ m.T
    inter = common.astype(np.int64)
    linked = 100 * inter >= percent * (size[:, None] + size[None] - inter)
    linked &= size[:, None] > 0
    return reached(ids, linked)


def reached(ids: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Per row of a symmetric matrix of links, the smallest id it reaches."""
    linked = linked | np.eye(len(ids), dtype=bool)
    root = ids.copy()
    while True:
        new = np.where(linked, root[None], np.iinfo(np.int64).max).min(axis=1)
        if (new == root).all():
            return root
        root = new


def narrowed(sets: DataFrame, tasks: DataFrame, percent: int, most: int = BLOCK) -> DataFrame:
    """(task, doc): ``tasks`` without the pairs that sketches tell apart; a document is in one task, if at most ``most`` hang together."""
    bins = max(partitions(sets.sparkSession), int(tasks.count() // BLOCK) + 1)
    rows = sets.join(tasks, sets["doc_id"] == tasks["doc"]).select(F.pmod("task", F.lit(bins)).alias("bin"), "task", "doc_id", "n_shingles", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        ids, task, size = (table.column(c).to_numpy() for c in ("doc_id", "task", "n_shingles"))
        parts = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        order = np.argsort(task, kind="stable")
        name, u, v = ([np.zeros(0, np.int64)] for _ in range(3))
        for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
            if len(at) > 1:
                may = possible(size[at], [parts[i] for i in at], percent)
                met = np.flatnonzero(may.sum(axis=1) > 1)  # others than itself
                if not met.size:
                    continue
                doc, one = np.unique(ids[at[met]], return_index=True)
                name.append(task[at[met]][one])
                u.append(doc)
                v.append(reached(ids[at[met]], may[np.ix_(met, met)])[one])
        return pa.table({"task": np.concatenate(name), "u": np.concatenate(u), "v": np.concatenate(v)})

    met = cut_lineage(rows.groupBy("bin").applyInArrow(compare, "task long, u long, v long"))
    block = cut_lineage(connected(met.select("u", "v")))
    large = block.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("root")
    once = block.join(large, "root", "left_anti").select(F.col("root").alias("task"), F.col("node").alias("doc"))
    again = met.join(block.join(large, "root", "left_semi").select(F.col("node").alias("u")), "u", "left_semi")
    return once.unionByName(again.select(F.xxhash64("task", "v").alias("task"), F.col("u").alias("doc")))


def links(docs: DataFrame, tasks: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): links that connect whatever is linked within a task; several tasks share a bin."""
    bins = max(partitions(docs.sparkSession), int(tasks.count() // BLOCK) + 1)
    # where few documents are compared, the others leave before their texts are shuffled
    wanted = small(cut_lineage(tasks.select(F.col("doc").alias("doc_id")).distinct()))
    docs = docs if wanted is None else docs.join(wanted, "doc_id", "left_semi")
    rows = docs.join(tasks, docs["doc_id"] == tasks["doc"]).select(F.pmod("task", F.lit(bins)).alias("bin"), "task", "doc_id", "text")

    def compare(table: pa.Table) -> pa.Table:
        # sets slice by slice, so only the hashes of the bin are held beside its texts
        parts = [shingles(b.column("text"), n) for b in slices(iter(table.to_batches()), "text", 1 << 20)]
        value = np.concatenate([v for v, _ in parts])
        offs = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))])
        ids, task = table.column("doc_id").to_numpy(), table.column("task").to_numpy()
        order = np.argsort(task, kind="stable")
        cuts = np.flatnonzero(np.diff(task[order])) + 1
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in np.split(order, cuts):
            if len(at) > 1:
                root = spanning_links(ids[at], [value[offs[i]:offs[i + 1]] for i in at], percent)
                moved = root != ids[at]
                u.append(ids[at][moved])
                v.append(root[moved])
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    return rows.groupBy("bin").applyInArrow(compare, "u long, v long")


def components(docs: DataFrame, n: int = 5, percent: int = 80, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = cut_lineage(described(docs, n))
    sketched = rows.filter("doc_id is not null and n_shingles > 0")
    rows, sets = rows.drop("sketch"), sketched.drop("sketch")
    classes = cut_lineage(sets.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    first = classes.select(F.col("first").alias("doc_id")).distinct()
    # where few documents are copies, these are left out, so no text is shuffled for it
    others = small(cut_lineage(sets.select("doc_id").distinct().join(first, "doc_id", "left_anti")))
    firsts = docs.join(first, "doc_id", "left_semi") if others is None else docs.filter("doc_id is not null").join(others, "doc_id", "left_anti")
    lists = cut_lineage(member_lists(firsts, n, percent, chunk))
    tasks = cut_lineage(comparisons(lists, block))
    free_shuffles(docs.sparkSession)  # of the signatures; not sooner, as Python lets go of what it held with a delay
    tasks = cut_lineage(narrowed(sketched, tasks, percent, block))
    found = cut_lineage(links(docs, tasks, n, percent))
    shared = classes.filter("n > 1").select("f1", "f2", "n_shingles", "first", "n").withColumn("key", F.xxhash64("f1", "f2", "n_shingles"))
    keyed = sets.withColumn("key", F.xxhash64("f1", "f2", "n_shingles"))
    stat = shared.select("key", "first", "n", F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n_shingles").alias("gn"))
    copies = lookup(keyed, stat, "key", "n", F.col("doc_id")).filter("first is not null and f1 = g1 and f2 = g2 and n_shingles = gn")
    roots = cut_lineage(connected(found.unionByName(copies.select(F.col("doc_id").alias("u"), F.col("first").alias("v")))))
    out = rows.join(roots, rows["doc_id"] == roots["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are not the smallest id of their component; rows without an id stay."""
    slim = docs.select("doc_id", "text")
    gone = cut_lineage(components(slim, n, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    few = small(gone)
    gone = gone if few is None else few
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")

"""Hard negatives by vertical scans with branch and bound.

Vectors are quantised to whole numbers and stored in blocks, dimension by
dimension, with the rows of a block sorted by label.  An anchor reads a block's
dimensions in the order of its own descending magnitudes and adds them to the
scores of the candidates left.  What the dimensions still unread can add at
least and at most follows from their minimum and maximum in the block; a
candidate whose score can no longer fall into a window that it would enter
leaves the candidate set, and the values of the dimensions behind are not read
for it.  Behind the last dimension scores are exact.

Two scans: the first finds each anchor's positives (best rows of its label),
which fix one window of scores per positive; the second finds the best rows of
other labels in each window.  A task keeps the best rows of its blocks per
anchor (or window), which narrows the windows as it goes; Spark merges the
tasks' lists.  Anchors are taken in chunks of at most ``CHUNK_BYTES``, each
broadcast to a scan of all blocks, so neither side grows a task and no pairs
are shuffled.  Nothing is approximated.

Defined cases: rows with a null id, label or vector, or with a null or
non-finite component, take no part; a shorter vector counts as filled up with
zeros; an empty vector scores 0 with all; rows that repeat an id are rows of
their own (an anchor's copy can be its positive); ties go to the smaller id;
a negative positive score has an empty window; components too large for exact
scores in 53 bits are refused; an empty table has no rows.  Other columns are
ignored, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from broadsheet.llm.blocks import release, sums
from broadsheet.llm.common import partitions, ranked
from broadsheet.session import cut_lineage

BLOCK_ROWS = 4096
CHUNK_BYTES = 16 << 20  # of anchors broadcast at once
STEP = 8  # dimensions between two looks at the bounds
NONE = -(1 << 62)  # score of an empty place in a list

_BLOCK = "size int, rows binary, ids binary, labels binary, anchors binary, columns binary"


def blocks_of(rows: DataFrame, scale: int) -> DataFrame:
    """Blocks of (row, id, label, vector, anchor), checkpointed; ``columns`` is dimensions x rows of int64."""
    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        vector = t.column("vector").combine_chunks()
        size = pc.list_value_length(vector).to_numpy(zero_copy_only=False).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(size)])
        values = vector.flatten().to_numpy(zero_copy_only=False).astype(float)
        fine = sums(~np.isfinite(values), offs) == 0
        label = t.column("label").to_numpy()
        order = np.flatnonzero(fine)
        order = order[np.argsort(label[order], kind="stable")]
        if not len(order):
            return
        full = np.zeros((len(size), int(size.max())))
        full[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(offs[:-1], size)] = np.where(np.isfinite(values), values, 0)
        full = np.floor(full[order].T * scale)
        if np.abs(full).max(initial=0) >= 1 << 52:
            raise ValueError("vector components are too large for exact scores")
        cols = [t.column(c).to_numpy()[order] for c in ("row", "id", "label")] + [t.column("anchor").to_numpy()[order].astype(np.uint8), full.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int32()), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols]],
                                         ["size", "rows", "ids", "labels", "anchors", "columns"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, BLOCK_ROWS - n))
                b, n = b.slice(BLOCK_ROWS - n), n + held[-1].num_rows
                if n == BLOCK_ROWS:
                    yield from packed(held)
                    held, n = [], 0
        if held:
            yield from packed(held)
        release()

    made = rows.mapInArrow(task, _BLOCK)
    return cut_lineage(made.repartition(partitions(rows.sparkSession)))  # few rows of a megabyte or two: even work for the scans


class Block:
    """One block as arrays, with the range of each label and the bounds of each dimension."""

    def __init__(self, r: dict):
        self.n = r["size"]
        self.rows, self.ids, self.labels = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "labels"))
        self.anchors = np.frombuffer(r["anchors"], np.uint8)
        self.whole = np.frombuffer(r["columns"], np.int64).reshape(-1, self.n)
        self.columns = self.whole.astype(float)

    def segment(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield Block(b.slice(k, 1).to_pylist()[0])


def vertical(columns: np.ndarray, least: np.ndarray, most: np.ndarray, anchor: np.ndarray, alive: np.ndarray,
             wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, exact scores) left of the block's columns for one anchor.

    ``alive`` is the bitmap of candidates to begin with; ``wanted(low, high)`` tells which may still
    be of use, given bounds on their scores.
    """
    d = min(len(anchor), len(columns))
    order = np.argsort(-np.abs(anchor[:d]), kind="stable")
    q = anchor[order]
    ends = q * least[order], q * most[order]
    low = np.concatenate([np.cumsum(np.minimum(*ends)[::-1])[::-1], [0.0]])  # what the dimensions from k on add at least
    high = np.concatenate([np.cumsum(np.maximum(*ends)[::-1])[::-1], [0.0]])
    at, score = None, np.zeros(columns.shape[1])
    for k in range(0, max(d, 1), STEP):
        for i in range(k, min(k + STEP, d)):
            score += q[i] * (columns[order[i]] if at is None else columns[order[i], at])
        end = min(k + STEP, d)
        keep = wanted(score + low[end], score + high[end])
        if at is None:
            keep &= alive
        left = np.count_nonzero(keep)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0)
        if end >= d or left < 0.75 * len(score):
            at = np.flatnonzero(keep) if at is None else at[keep]
            score = score[keep]
        elif at is None:
            alive = keep
    return at, score


def _exact(block: Block, vectors: np.ndarray) -> None:
    d = min(block.whole.shape[0], vectors.shape[1])
    if float(np.abs(block.columns).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(d, 1) >= 1 << 53:
        raise ValueError("vector components are too large for exact scores")


def _best(k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


_FOUND = "anchor long, place int, id long, score long"


def _listed(anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Rows of the filled places of (anchor, place, k) lists."""
    a, p, k = np.nonzero(scores > NONE)
    return pa.RecordBatch.from_arrays([pa.array(anchors[a]), pa.array(p.astype(np.int32)), pa.array(ids[a, p, k]), pa.array(scores[a, p, k])],
                                      ["anchor", "place", "id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (anchor, place) with their ``rank``; tasks hand over k each at most."""
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _positives(blocks: DataFrame, chunk, k: int) -> DataFrame:
    """The best k other rows of each anchor's label."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, vectors = (chunk.value[c] for c in ("rows", "labels", "vectors"))
        scores, ids = np.full((len(rows), 1, k), NONE), np.zeros((len(rows), 1, k), np.int64)
        for b in _blocks(batches):
            _exact(b, vectors)
            for label in np.unique(b.labels):
                a, z = b.segment(label)
                columns = b.columns[:, a:z]
                least, most = columns.min(axis=1, initial=np.inf), columns.max(axis=1, initial=-np.inf)
                for i in np.flatnonzero(labels == label):
                    at, s = vertical(columns, least, most, vectors[i], b.rows[a:z] != rows[i], lambda low, high: high >= scores[i, 0, -1])  # noqa: B023
                    if len(at):
                        scores[i, 0], ids[i, 0] = _best(k, np.concatenate([scores[i, 0], s.astype(np.int64)]), np.concatenate([ids[i, 0], b.ids[a:z][at]]))
        yield _listed(rows, scores, ids)
        release()

    return _top(blocks.mapInArrow(task, _FOUND), k)


def _negatives(blocks: DataFrame, chunk, k: int) -> DataFrame:
    """The best k rows of other labels in each window of each anchor."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, vectors, lows, highs = (chunk.value[c] for c in ("rows", "labels", "vectors", "lows", "highs"))
        scores, ids = np.full((*lows.shape, k), NONE), np.zeros((*lows.shape, k), np.int64)
        some = np.flatnonzero((lows <= highs).any(axis=1))
        for b in _blocks(batches):
            _exact(b, vectors)
            least, most = b.columns.min(axis=1, initial=np.inf), b.columns.max(axis=1, initial=-np.inf)
            for i in some:
                a, z = b.segment(labels[i])
                if z - a == b.n:
                    continue
                alive = np.ones(b.n, bool)
                alive[a:z] = False
                open_ = np.flatnonzero(lows[i] <= highs[i])
                floor, top = np.maximum(lows[i, open_], scores[i, open_, -1]), highs[i, open_]

                def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    keep = np.zeros(len(low), bool)
                    for f, t in zip(floor, top):  # noqa: B023
                        keep |= (high >= f) & (low <= t)
                    return keep

                at, s = vertical(b.columns, least, most, vectors[i], alive, wanted)
                for p, f, t in zip(open_, floor, top):
                    inside = (s >= f) & (s <= t)
                    if inside.any():
                        scores[i, p], ids[i, p] = _best(k, np.concatenate([scores[i, p], s[inside].astype(np.int64)]),
                                                        np.concatenate([ids[i, p], b.ids[at[inside]]]))
        yield _listed(rows, scores, ids)
        release()

    return _top(blocks.mapInArrow(task, _FOUND), k)


def _anchors(blocks: DataFrame) -> DataFrame:
    """(row, id, label, vector as int64 bytes) of the anchors."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            at = np.flatnonzero(b.anchors)
            vectors = [np.ascontiguousarray(b.whole[:, k]).tobytes() for k in at]
            yield pa.RecordBatch.from_arrays([pa.array(b.rows[at]), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(vectors, pa.binary())],
                                             ["row", "id", "label", "vector"])

    return blocks.mapInArrow(task, "row long, id long, label long, vector binary")


def mine(rows: DataFrame, anchor: Column, vector: str = "embedding", key: str = "vec_id", label: Column | None = None, positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` chooses the anchors among ``rows``, ``label`` (default the column
    label) is their class.  A score is the inner product of floor(scale * x).
    Of an anchor's first ``positives`` rows of its class, each gets the first
    ``negatives`` rows of other classes with low * positive_score <= 100 *
    negative_score <= high * positive_score.
    """
    spark = rows.sparkSession
    taken = rows.select(F.col(key).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    taken = taken.withColumn("row", F.monotonically_increasing_id()).filter("id is not null and label is not null and vector is not null")
    blocks = blocks_of(taken.select("row", "id", "label", "vector", "anchor"), scale)
    every = ranked(_anchors(blocks), [F.col("row")], "at")
    n, widest = every.agg(F.count(F.lit(1)), F.max(F.octet_length("vector"))).first()
    per = max(1, chunk_bytes // max(widest or 1, 64 + 24 * positives * (1 + negatives)))  # anchors and the lists a task keeps of them
    results = []
    for first in range(0, max(n, 1), per):
        held = every.filter(F.col("at").between(first, first + per - 1)).orderBy("at").collect()
        vectors = np.zeros((len(held), (widest or 0) // 8))
        for i, r in enumerate(held):
            v = np.frombuffer(r["vector"], np.int64)
            vectors[i, :len(v)] = v
        arrays = {"rows": np.array([r["row"] for r in held], np.int64), "labels": np.array([r["label"] for r in held], np.int64), "vectors": vectors}
        best = cut_lineage(_positives(blocks, spark.sparkContext.broadcast(arrays), positives)
                           .select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        place = {r["row"]: i for i, r in enumerate(held)}
        lows, highs = np.ones((len(held), positives), np.int64), np.zeros((len(held), positives), np.int64)
        for r in best.collect():  # up to ``positives`` an anchor of the chunk
            lows[place[r["anchor"]], r["place"]] = -(-low * r["positive_score"] // 100)
            highs[place[r["anchor"]], r["place"]] = high * r["positive_score"] // 100
        found = _negatives(blocks, spark.sparkContext.broadcast(arrays | {"lows": lows, "highs": highs}), negatives)
        named = every.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        out = found.join(best, ["anchor", "place"]).join(named, "anchor")
        results.append(cut_lineage(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                              "positive_score", F.col("score").alias("negative_score"))))
    return reduce(DataFrame.unionByName, results)

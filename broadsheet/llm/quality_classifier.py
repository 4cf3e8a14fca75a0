"""Quality classifier: ridge regression on random Fourier features, with isotonic calibration.

Every text is reduced to ``STATS`` statistics of its characters, words and
lines.  They are standardised and mapped to ``features`` random cosines whose
inner products approximate a Gaussian kernel, so a linear ridge fit on them is
a kernel fit.  Tasks sum their part of the normal equations (features^2
numbers); the parts are added in Spark in two levels and one small system is
solved.  Raw scores of rows kept out of the fit are put in ``CALIBRATION_BINS``
bins, and pool-adjacent-violators over the bins gives a monotone map to [0, 1].

Defined cases: null and empty texts have zero statistics and get a score like
any other; a label without a document or with a null value is ignored, several
labels of one id are averaged; without labels every score is 0.5; rows that
repeat an id are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.blocks import slices, sums, text_bytes, word_hashes, words
from broadsheet.session import cut_lineage

CALIBRATION_BINS = 4096
LOW, HIGH = -0.5, 1.5  # range of raw scores the bins cover; the outer bins take the rest
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!?", b"|", b"#*$%&<>@^~=+_\\",
           b"()[]{}", b"'\"-/", b"\n", b" \t", bytes(range(128, 256))]
STATS = len(CLASSES) + 13


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, STATS) float matrix."""
    data, offs = text_bytes(column)
    n = int(offs[-1])
    size = np.maximum(np.diff(offs), 1)
    raw = data[:n]
    cols = []
    for c in CLASSES:
        lut = np.zeros(256, bool)
        lut[list(c)] = True
        cols.append(sums(lut[raw], offs) / size)
    s, e, first = words(data, offs)
    count = np.diff(first)
    some = np.maximum(count, 1)
    length = (e - s).astype(float)
    mean = sums(length, first) / some
    h = word_hashes(data, s, e)
    head, tail = data[s], data[e - 1]
    upper = (head >= 65) & (head <= 90)
    second = data[np.minimum(s + 1, max(n - 1, 0))] if n else head
    shout = upper & (second >= 65) & (second <= 90)
    odd_end = ~(((tail | 32) >= 97) & ((tail | 32) <= 122)) & (tail < 128) & ~np.isin(tail, list(b".,"))
    of = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    kinds = np.bincount(of[order][new], minlength=len(count)) if len(h) else np.zeros(len(count))
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    # lines as texts of their own: hashes of their bytes found by word hashing of whole lines
    breaks = np.flatnonzero(raw == 10)
    ls = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    le = np.append(ls[1:], n)
    lof = np.searchsorted(offs, ls, "right") - 1
    lof = np.minimum(lof, len(count) - 1) if len(count) else lof
    le = np.where(np.isin(le - 1, breaks, assume_unique=False), le - 1, le)
    full = le > ls
    ls, le, lof = ls[full], le[full], lof[full]
    lh = word_hashes(data, ls, le)
    lines = np.bincount(lof, minlength=len(count)).astype(float)
    pairs = np.unique(np.stack([lof.astype(np.uint64), lh]), axis=1) if len(lh) else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=len(count)) if len(lh) else np.zeros(len(count))
    short = np.bincount(lof, (le - ls < 40).astype(float), len(count))
    some_lines = np.maximum(lines, 1)
    cols += [np.log1p(count), mean, np.sqrt(np.maximum(sums(length**2, first) / some - mean**2, 0)), kinds / some,
             np.log1p(kinds), sums(upper, first) / some, sums(shout, first) / some, sums(odd_end, first) / some,
             sums(again, first) / some, distinct / some_lines, np.log1p(lines), short / some_lines, sums(length > 20, first) / some]
    return np.stack([np.asarray(c, float) for c in cols], axis=1)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, stats) per row: a fixed-size array, all later steps work on it alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 21):
            m = statistics(b.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(m.astype(np.float32).ravel()), STATS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "stats"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(task, "doc_id long, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, STATS)


class Kernel:
    """Standardisation and random cosines; the draw depends on the seed only."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.standard_normal((STATS, features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.size = features + 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))], axis=1)


def normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of f f', sum of f y, rows) over rows (stats, y)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((kernel.size, kernel.size + 1))
        n = 0
        for b in batches:
            if b.num_rows:
                f, y = kernel(_matrix(b.column("stats"))), b.column("y").to_numpy()
                total[:, :-1] += f.T @ f
                total[:, -1] += f.T @ y
                n += len(y)
        if n:
            flat = pa.ListArray.from_arrays(np.arange(kernel.size + 1, dtype=np.int32) * (kernel.size + 1), pa.array(total.ravel()))
            yield pa.RecordBatch.from_pydict({"i": np.arange(kernel.size), "lane": np.full(kernel.size, TaskContext.get().partitionId() % 32),
                                              "n": np.full(kernel.size, n), "v": flat})

    def added(table: pa.Table) -> pa.Table:
        v = np.asarray(table.column("v").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
        return pa.table({"i": table.column("i")[:1], "lane": table.column("lane")[:1], "n": [sum(table.column("n").to_pylist())], "v": [v.tolist()]})

    schema = "i long, lane long, n long, v array<double>"
    parts = rows.select("stats", "y").mapInArrow(task, schema)
    whole = parts.groupBy("i", "lane").applyInArrow(added, schema).groupBy("i").applyInArrow(added, schema).orderBy("i").collect()
    if not whole:
        return np.zeros((kernel.size, kernel.size)), np.zeros(kernel.size), 0
    m = np.array([r["v"] for r in whole])
    return m[:, :-1], m[:, -1], whole[0]["n"]


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone least-squares fit through points (x ascending, mean y, weight n)."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit_and_score(docs: DataFrame, labels: DataFrame, label: str, fit: Column, calibrate: Column, features: int = 384,
                  width: float = 4.0, ridge: float = 1e-3, seed: int = 7) -> DataFrame:
    """(doc_id, score) per row of ``docs``; ``fit`` and ``calibrate`` are conditions on doc_id that pick the labelled rows of each step."""
    stats = cut_lineage(text_statistics(docs))
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    known = cut_lineage(stats.join(y, "doc_id").withColumn("use", F.when(fit, "fit").when(calibrate, "calibrate")).filter("use is not null"))
    train, check = known.filter("use = 'fit'"), known.filter("use = 'calibrate'")
    moments = train.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not moments:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    kernel = Kernel(np.array([r["m"] for r in moments]), np.array([r["s"] for r in moments]), features, width, seed)
    a, b, n = normal_equations(train, kernel)
    penalty = ridge * n * np.eye(kernel.size)
    penalty[-1, -1] = 1e-9 * n
    beta = np.linalg.solve(a + penalty, b)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = kernel(_matrix(batch.column("stats"))) @ beta
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(r)], [batch.schema.names[0], "raw"])

    position = F.floor((F.col("raw") - LOW) / (HIGH - LOW) * CALIBRATION_BINS)
    bins = (check.select("y", "stats").mapInArrow(raw, "y double, raw double")
            .groupBy(F.greatest(F.lit(0), F.least(F.lit(CALIBRATION_BINS - 1), position)).alias("bin"))
            .agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("x").collect())
    knots, values = isotonic(*(np.array([r[c] for r in bins], float) for c in "xyn")) if bins else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in raw(batches):
            r = batch.column("raw").to_numpy()
            # a thousandth of a logistic of the raw score keeps the order inside flat parts
            s = 0.999 * np.interp(r, knots, values) + 0.001 / (1 + np.exp(-np.clip(4 * r - 2, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(s, 0, 1))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(scored, "doc_id long, score double")

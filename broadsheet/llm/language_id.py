"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte model: contexts of 0 to ``ORDER``
bytes, each with the counts of the bytes seen behind it.  A byte that a context
has seen n times of T costs -log2(n / (T + q)) bits, q being the number of
different bytes seen there; another byte costs the escape, -log2(q / (T + q)),
and is coded one order lower, at last with 8 bits.  Statistics are frozen after
training, so a text's code length in a language is exact and the same in any
order; the language with the shortest code wins.

Counts cover all training texts.  Tasks count (language, 4 bytes) and Spark
sums; lower orders are marginals.  ``identify`` uses all counts at any size.  A
model of up to ``max_entries`` numbers (grams times languages) is broadcast.  A larger
one stays a table dealt by the two middle bytes, where all counts of a context
of two or three bytes meet; only contexts of up to one byte are broadcast, and
the code lengths of the most frequent grams (``max_entries`` numbers in all).
Tasks add those up and hand on the other grams of each text, which are coded
in the shards and joined back.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows without a language or text do not train; without any training row all
texts are ``und``; of languages with equal codes the first by name wins; rows
that repeat an id are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.blocks import IntTable, slices, sums, text_bytes
from broadsheet.llm.common import lookup, partitions
from broadsheet.session import cut_lineage

ORDER = 3
MAX_ENTRIES = 8_000_000
MAX_FREQUENT = 1_000_000  # numbers of the frequent grams broadcast beside a sharded model
FLUSH = 1_000_000
SHARD_COSTS = 4_000_000  # code lengths a shard of a large model has, about


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Per byte of the texts, itself and the ORDER bytes before it (0 before the start) as one integer."""
    n = int(offs[-1])
    pos = np.arange(n) - np.repeat(offs[:-1], np.diff(offs))
    out = data[:n].astype(np.uint32)
    for k in range(1, ORDER + 1):
        if n > k:
            out[k:] += np.where(pos[k:] >= k, data[:n - k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows (lang, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                g, c = _merged(parts)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(g), "gram": g.astype(np.int64), "n": c})
            held.clear()

        for b in slices(batches, "text"):
            names = b.column("lang").to_pylist()
            for lang in dict.fromkeys(names):
                rows = b.filter(pa.array([x == lang for x in names]))
                g, c = np.unique(grams(*text_bytes(rows.column("text"))), return_counts=True)
                held.setdefault(lang, []).append((g, c))
                if len(held[lang]) > 8:
                    held[lang] = [_merged(held[lang])]
            size = sum(len(g) for parts in held.values() for g, _ in parts)
            if size > FLUSH:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([p[1] for p in parts]), len(g)).astype(np.int64)


class Model:
    """Code lengths of all languages: per order a table of known grams and one of known contexts.

    Orders that ``low`` has are taken from there; ``top`` is the last one.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, top: int = ORDER, low: Model | None = None):
        self.langs, width = langs, len(langs)
        self.cost, self.escape, self.grams, self.contexts = (list(x) for x in (low.cost, low.escape, low.grams, low.contexts)) if low else ([], [], [], [])
        for order in range(len(self.cost), top + 1):
            part = gram & ((1 << 8 * (order + 1)) - 1)
            (pair, at) = np.unique(lang.astype(np.int64) << 40 | part, return_inverse=True)
            count = np.bincount(at, n, len(pair))
            who, what = pair >> 40, pair & ((1 << 40) - 1)
            (ctx, at) = np.unique(who << 40 | what >> 8, return_inverse=True)
            total, kinds = np.bincount(at, count, len(ctx)), np.bincount(at, minlength=len(ctx))
            known, row = np.unique(what, return_inverse=True)
            seen, crow = np.unique(ctx & ((1 << 40) - 1), return_inverse=True)
            escape = np.zeros((len(seen), width))
            escape[crow, ctx >> 40] = -np.log2(kinds / (total + kinds))
            if order == 0:  # every byte has a code: its own or the escape and 8 bits
                known, row = np.arange(256), what
                cost = np.repeat(escape, 256, axis=0) + 8.0 if len(seen) else np.full((256, width), 8.0)
            else:
                suffix = self.grams[-1].find(known & ((1 << 8 * order) - 1))
                cost = escape[np.searchsorted(seen, known >> 8)] + self.cost[-1][suffix]
            cost[row, who] = -np.log2(count / (total + kinds)[at])
            self.grams.append(IntTable(known))
            self.contexts.append(IntTable(seen))
            self.cost.append(cost.astype(np.float32))
            self.escape.append(escape.astype(np.float32))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte behind the others, one column a language."""
        out = np.zeros((len(gram), len(self.langs)), np.float32)
        left = np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            part = gram[left].astype(np.int64) & ((1 << 8 * (order + 1)) - 1)
            at = self.grams[order].find(part)
            hit = at >= 0
            if order == ORDER:
                out[hit] = self.cost[order][at[hit]]
            else:
                out[left[hit]] += self.cost[order][at[hit]]
            left, part = left[~hit], part[~hit]
            if not left.size:
                break
            ctx = self.contexts[order].find(part >> 8)
            out[left[ctx >= 0]] += self.escape[order][ctx[ctx >= 0]]
        return out

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        bits = self.bits(grams(data, offs))
        return np.stack([sums(bits[:, k].astype(np.float64), offs) for k in range(len(self.langs))], axis=1)


def training_counts(rows: DataFrame) -> DataFrame:
    """The checkpointed count_grams of the rows (lang, text) that train."""
    return cut_lineage(count_grams(rows.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")))


def _collected(counts: DataFrame, **orders) -> Model | None:
    table = counts.select("lang", "gram", "n").toArrow()
    if not table.num_rows:
        return None
    names = table.column("lang").to_pylist()
    langs = sorted(set(names), key=str.encode)
    place = {x: i for i, x in enumerate(langs)}
    order = np.argsort(table.column("gram").to_numpy(), kind="stable")
    return Model(langs, np.array([place[x] for x in names])[order], table.column("gram").to_numpy()[order], table.column("n").to_numpy()[order], **orders)


def train(rows: DataFrame) -> Model | None:
    """A model of all counts of the rows (lang, text), on the driver; None without training rows.

    For texts whose model fits there; ``identify`` measures that.
    """
    return _collected(training_counts(rows))


def _judged(cost: np.ndarray, letter: np.ndarray, size: np.ndarray, langs: list[str]) -> list[pa.Array]:
    """lang_pred, score and bits_per_byte of texts of ``size`` bytes and code lengths ``cost``."""
    best = cost.argmin(axis=1)
    least = cost.min(axis=1)
    pred = np.where(letter, np.array(langs, object)[best], "und")
    score = np.where(letter, 1 / np.exp2(-np.minimum(cost - least[:, None], 1000)).sum(axis=1), 0.0)
    rate = np.where(letter, least / np.maximum(size, 1), 0.0)
    return [pa.array(pred, pa.string()), pa.array(score), pa.array(rate)]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(text).alias("__t"),
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))


JUDGED = ["lang_pred", "score", "bits_per_byte"]


def _schema(doc: T.StructField) -> T.StructType:
    return T.StructType([doc, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])


def _unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns if c not in JUDGED], *sorted(JUDGED))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred, score (posterior of the winner under a flat prior) and bits_per_byte."""
    share = docs.sparkSession.sparkContext.broadcast(model)
    rows = _texts(docs, text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for b in slices(batches, "__t", 1 << 21):
            n = b.num_rows
            if m is None:
                judged = [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n))]
            else:
                data, offs = text_bytes(b.column("__t"))
                judged = _judged(m.code_lengths(data, offs), b.column("__letter").to_numpy(zero_copy_only=False), np.diff(offs), m.langs)
            yield pa.RecordBatch.from_arrays([b.column("__doc"), *judged], ["__doc", *JUDGED])

    return _unpacked(rows.mapInArrow(task, _schema(rows.schema["__doc"])), docs)


def predict_sharded(docs: DataFrame, counts: DataFrame, max_entries: int = MAX_FREQUENT, text: str = "text") -> DataFrame:
    """``predict`` by the model of all ``counts`` (not empty, checkpointed), which is never in one place."""
    spark = docs.sparkSession
    low = _collected(counts.groupBy("lang", F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")), top=1)
    langs, width = low.langs, len(low.langs)
    shorter = spark.sparkContext.broadcast(low)
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    shards = max(partitions(spark), counts.count() * width // SHARD_COSTS + 1)
    shard = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(shards)).cast("int").alias("shard")
    held = counts.select(shard, number.cast("int").alias("k"), "gram", "n").groupBy("shard")

    def code(wanted: pa.Table, known: pa.Table) -> pa.Table:
        cost = np.zeros((0, width), np.float32)
        if wanted.num_rows:
            model = Model(langs, *(known.column(c).to_numpy() for c in ("k", "gram", "n")), low=shorter.value)
            cost = model.bits(wanted.column("gram").to_numpy())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cost) + 1) * width, pa.int32()), pa.array(cost.ravel()))
        return pa.table({"gram": wanted.column("gram"), "uses": wanted.column("uses"), "costs": lists})

    def coded(wanted: DataFrame) -> DataFrame:
        return wanted.select(shard, "gram", "uses").groupBy("shard").cogroup(held).applyInArrow(code, "gram long, uses long, costs array<float>")

    # the most frequent grams: classes of counts from the top, as many as fit
    totals = counts.groupBy("gram").agg(F.sum("n").alias("uses")).withColumn("class", F.floor(8 * F.log2("uses")))
    room, least = max_entries // width, None
    for c, n in sorted(totals.groupBy("class").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = c
    top = coded(totals.filter(F.col("class") >= F.lit(least))).toArrow() if least is not None else None
    if top is None:
        frequent = IntTable(np.zeros(0, np.int64)), np.zeros((0, width), np.float32)
    else:
        costs = top.column("costs").combine_chunks().flatten().to_numpy()
        frequent = IntTable(top.column("gram").to_numpy()), costs.reshape(-1, width)
    share = spark.sparkContext.broadcast(frequent)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cost = share.value
        for b in slices(batches, "__t", 1 << 21):
            data, offs = text_bytes(b.column("__t"))
            g = grams(data, offs)
            at = table.find(g)
            hit = at >= 0
            bits = np.zeros((len(g), width), np.float32)
            bits[hit] = cost[at[hit]]
            part = np.stack([sums(bits[:, k].astype(np.float64), offs) for k in range(width)], axis=1)
            of = np.repeat(np.arange(b.num_rows), np.diff(offs))[~hit]
            pair, n = np.unique(of << 32 | g[~hit].astype(np.int64), return_counts=True)
            to = pa.array(np.searchsorted(pair >> 32, np.arange(b.num_rows + 1)), pa.int32())
            parts = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * width, pa.int32()), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("__row"), b.column("__doc"), b.column("__letter"), pa.array(np.diff(offs)), parts,
                 pa.ListArray.from_arrays(to, pa.array(pair & 0xFFFFFFFF)), pa.ListArray.from_arrays(to, pa.array(n))],
                ["__row", "__doc", "__letter", "__size", "__part", "__gram", "__n"])

    rows = _texts(docs, text).withColumn("__row", F.monotonically_increasing_id())
    fields = [rows.schema[c] for c in ("__row", "__doc", "__letter")] + [
        T.StructField("__size", T.LongType()), T.StructField("__part", T.ArrayType(T.DoubleType())),
        T.StructField("__gram", T.ArrayType(T.LongType())), T.StructField("__n", T.ArrayType(T.LongType()))]
    begun = cut_lineage(rows.select("__row", "__doc", "__t", "__letter").mapInArrow(split, T.StructType(fields)))
    rest = begun.select("__row", F.explode(F.arrays_zip("__gram", "__n")).alias("x")).select("__row", F.col("x.__gram").alias("gram"), F.col("x.__n").alias("n"))
    costs = cut_lineage(coded(rest.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))))
    met = lookup(rest, costs, "gram", "uses", F.col("__row"))
    more = met.groupBy("__row").agg(F.array(*[F.sum(F.col("costs")[k].cast("double") * F.col("n")) for k in range(width)]).alias("__more"))
    total = F.when(F.col("__more").isNull(), F.col("__part")).otherwise(F.zip_with("__part", "__more", lambda a, b: a + b))
    ready = begun.drop("__gram", "__n").join(more, "__row", "left").select("__doc", "__letter", "__size", total.alias("__cost"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cost = b.column("__cost").flatten().to_numpy().reshape(-1, width)
                judged = _judged(cost, b.column("__letter").to_numpy(zero_copy_only=False), b.column("__size").to_numpy(), langs)
                yield pa.RecordBatch.from_arrays([b.column("__doc"), *judged], ["__doc", *JUDGED])

    return _unpacked(ready.mapInArrow(judge, _schema(rows.schema["__doc"])), docs)


def identify(docs: DataFrame, learn: Column, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Train on the rows of ``docs`` where ``learn`` holds and predict all: doc_id, text-free."""
    counts = training_counts(docs.filter(learn).select("lang", "text"))
    slim = docs.select("doc_id", F.col("text").alias("__text"))
    langs = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    entries, width = langs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if entries * width <= max_entries:  # the model has a number for every gram in every language
        found = predict(slim, _collected(counts), "__text")
    else:
        found = predict_sharded(slim, counts, min(max_entries, MAX_FREQUENT), "__text")
    return found.drop("__text")

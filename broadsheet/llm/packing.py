"""Mixture-controlled packing: deficit round-robin over source queues.

Documents become token ids (a closing id behind each) and queue up per source,
by id.  Each queue is served in packets of up to ``packet`` tokens, cut at
multiples of it within a document.  In every round of ``window`` tokens a queue
gains its quantum, ``window`` times its share of the target weights, and sends
packets while its deficit covers them; what is left is carried to the next
round.  A queue that never idles has gained (r + 1) * quantum when round r
ends, so a packet that ends at token e of its queue goes out in round
ceil(e / quantum) - 1.  This closed form gives every packet its round from a
running sum, whatever partition it is in: the carried deficits need no pass
over the rounds.  Rounds follow each other, queues within a round in source
order, and the stream is cut into sequences of ``length`` tokens.  After each
round a source has sent its target to less than one packet.

By default the targets are the sources' shares of all tokens, so all queues end
with the last round and every stretch of the stream has the mix of the corpus.  With other
weights queues run dry at their own time; the rest keep their proportions.

Nothing is padded but the end: what is behind the last full sequence is cut
into powers of two, which need no padding.

Ids are computed once, stored as Parquet in the checkpoint folder, and only
counts move until the places are known.

Defined cases: null and empty texts are the closing id alone; null sources are
a queue of their own, first; null ids come first; rows that repeat an id are
ordered by their tokens, and rows equal in source, id and tokens are
interchangeable; a very long text is cut like any other; an empty table packs
to no sequence.  Other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from broadsheet.llm.blocks import release, slices
from broadsheet.llm.common import let, lookup, partitions
from broadsheet.session import cut_lineage, ensure_checkpoint_dir

LENGTH = 2048  # tokens of a sequence
WINDOW = 16 * LENGTH  # tokens of a round
PACKET = 256  # tokens a queue sends at once
CLOSING = 1  # the id behind each document
SHORT = 100_000  # characters of a text that the pattern engine takes whatever they are


def tokenizer_path() -> str:
    """The 50k byte-level BPE of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_pattern() -> str:
    """The pre-token pattern of that tokenizer."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Tokenizer:
    """Ids of a byte-level BPE model (its JSON), special strings of the text included.

    The merges run in tiktoken, on ranks read from the model: the same ids at
    several times the speed.  Texts its pattern engine gives up on (runs of
    millions of blanks) are left to the model's own library.
    """

    def __init__(self, model: bytes, pattern: str):
        import tiktoken

        self.model, self.slow = model, None
        spec = json.loads(model)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # byte-level models spell a byte as a printable character: itself where it is one, else from U+0100 on
        shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
        spelled = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(map(spelled.__getitem__, w)): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.fast = tiktoken.Encoding("model", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.marks = list(special)
        self.size = max([*ranks.values(), *special.values()]) + 1

    def ids(self, text: str) -> list[int]:
        if len(text) <= SHORT and not any(m in text for m in self.marks):
            return self.fast.encode_ordinary(text)  # fails hard where the pattern engine gives up
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            if self.slow is None:
                from tokenizers import Tokenizer as Library
                self.slow = Library.from_str(self.model.decode())
            return self.slow.encode(text, add_special_tokens=False).ids


_loaded: dict = {}


def _tokenizer(model: bytes, pattern: str) -> Tokenizer:
    """The tokenizer of this Python worker, kept between tasks."""
    key = (hash(model), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(model, pattern)
    return _loaded[key]


def tokenized(docs: DataFrame, path: str | None = None, pattern: str | None = None, closing: int = CLOSING) -> DataFrame:
    """(row, doc_id, source, n, crc, wide, ids) of all rows, stored as Parquet: ``ids`` has two bytes an id, four where ``wide``."""
    spark = docs.sparkSession
    with open(path or tokenizer_path(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # one or two megabytes
    pattern = pattern or byte_pattern()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(model.value, pattern)
        wide = max(tok.size, closing + 1) > 1 << 16
        for b in slices(batches, "text"):
            found = []
            for t in b.column("text").to_pylist():
                ids = tok.ids(t) if t else []
                ids.append(closing)
                found.append(array("I" if wide else "H", ids).tobytes())
            n = np.array([len(x) for x in found], np.int64) // (4 if wide else 2)
            cols = [pa.array(n), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array([wide] * len(found)), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row", "doc_id", "source")], *cols], ["row", "doc_id", "source", "n", "crc", "wide", "ids"])
        release()

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").withColumn("row", F.monotonically_increasing_id())
    kinds = [T.StructField("row", T.LongType()), rows.schema["doc_id"], rows.schema["source"]]
    out = rows.mapInArrow(task, T.StructType([T.StructField(f.name, f.dataType) for f in kinds] + [
        T.StructField("n", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("wide", T.BooleanType()), T.StructField("ids", T.BinaryType())]))
    folder = f"{ensure_checkpoint_dir(spark)}/packing-{uuid.uuid4().hex}"
    out.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def running_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over all rows before, by ``order``.

    Range partitions are summed locally; their totals (one row each) give the offsets.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = total + np.cumsum(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - v), pa.array(np.full(len(v), part, np.int32))], [*b.schema.names, "__local", "__pid"])
            total = int(upto[-1]) if len(v) else total

    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    kinds = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    parts = cut_lineage(ranged.mapInArrow(local, T.StructType([*kinds, T.StructField("__local", T.LongType()), T.StructField("__pid", T.IntegerType())])))
    offsets = (parts.groupBy("__pid").agg(F.sum(value).alias("__sum"))
               .select("__pid", (F.sum("__sum").over(W.orderBy("__pid")) - F.col("__sum")).alias("__off")))
    return parts.join(F.broadcast(offsets), "__pid").select(*df.columns, (F.col("__off") + F.col("__local")).alias(out))


def _fragments(queue: DataFrame, packet: int) -> DataFrame:
    """Documents cut where their round changes: (row, start, size, round, turn, at)."""
    def upto(j: Column) -> Column:
        return F.least(j * packet, F.col("n"))

    def round_of(j: Column) -> Column:
        return F.ceil((F.col("offset") + upto(j)) / F.col("quantum")).cast("long") - 1

    n = F.ceil(F.col("n") / packet).cast("long")
    last = F.filter(F.sequence(F.lit(1).cast("long"), n), lambda j: (j == n) | (round_of(j) != round_of(j + 1)))  # packets that end a round
    cuts = let(last, lambda ends: F.transform(ends, lambda j, i: F.struct(
        F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1) * packet).alias("start"), upto(j).alias("upto"), round_of(j).alias("round"))))
    return (queue.select("row", "offset", F.col("first").alias("turn"), F.explode(cuts).alias("c"))
            .select("row", F.col("c.start").alias("start"), (F.col("c.upto") - F.col("c.start")).alias("size"), F.col("c.round").alias("round"),
                    "turn", (F.col("offset") + F.col("c.start")).alias("at")))


def _pieces(fragments: DataFrame, total: int, length: int) -> DataFrame:
    """Fragments (with ``pos``, their place in the stream) cut into sequences."""
    full, rest = divmod(total, length)
    starts = [full * length]  # of the sequences behind the full ones
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            starts.append(starts[-1] + (1 << bit))
    behind = F.array(*[F.lit(s).cast("long") for s in starts])

    def sequence_of(x: Column) -> Column:
        return F.when(x < starts[0], F.floor(x / length)).otherwise(full - 1 + sum(((x >= s).cast("long") for s in starts), F.lit(0).cast("long")))

    def begin(k: Column) -> Column:
        return F.when(k <= full, k * length).otherwise(F.element_at(behind, (k - full + 1).cast("int")))

    k = F.col("sequence_id")
    cut = fragments.withColumn("sequence_id", F.explode(F.sequence(sequence_of(F.col("pos")), sequence_of(F.col("pos") + F.col("size") - 1))))
    cut = cut.withColumn("begin", begin(k)).withColumn("a", F.greatest("pos", "begin")).withColumn("z", F.least(F.col("pos") + F.col("size"), begin(k + 1)))
    return cut.select("row", (F.col("start") + F.col("a") - F.col("pos")).alias("start"), (F.col("z") - F.col("a")).alias("length"),
                      "sequence_id", (F.col("a") - F.col("begin")).alias("offset"), "round")


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, round long"


def pack(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, packet: int = PACKET, weight: Column | None = None,
         path: str | None = None, pattern: str | None = None, closing: int = CLOSING, ids: bool = False) -> DataFrame:
    """Every piece of every document and its place: (doc_id, source, ``_PIECE``), and the piece's ids where ``ids``.

    ``weight`` is a positive expression over (source, tokens), one value a source.
    """
    tokens = tokenized(docs, path, pattern, closing)
    narrow = tokens.select("row", "doc_id", "source", "crc", "n").withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    queue = running_sum(narrow, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.col("crc"), F.col("row")], "n", "before")
    sources = queue.groupBy("name").agg(F.first("source").alias("source"), F.min("before").alias("first"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sources = cut_lineage(sources.withColumn("weight", (F.col("tokens") if weight is None else weight).cast("double")))
    rows, total, weights = sources.agg(F.sum("rows"), F.sum("tokens"), F.sum("weight")).first()
    stats = sources.select("name", "first", (F.col("weight") * (window / (weights or 1))).alias("quantum"), "rows")
    queue = lookup(queue, stats, "name", "rows", F.col("row"), rows or 0).withColumn("offset", F.col("before") - F.col("first"))
    placed = running_sum(_fragments(queue, packet), [F.col("round"), F.col("turn"), F.col("at")], "size", "pos")
    pieces = _pieces(placed, total or 0, length).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "round")).alias("pieces"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "round"] + ["ids"] * ids
        for b in slices(batches, "ids"):
            lists = b.column("pieces")
            p = lists.flatten()
            of = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            start, size = (p.field(c).to_numpy() for c in ("start", "length"))
            raw, wide = b.column("ids"), b.column("wide").to_pylist()
            crcs, held, at, four = [], [], -1, b""
            for k, s, m in zip(of.tolist(), start.tolist(), size.tolist()):
                if k != at:
                    at, four = k, memoryview(np.frombuffer(raw[k].as_buffer(), "<u4" if wide[k] else "<u2").astype("<u4").tobytes())
                crcs.append(zlib.crc32(four[4 * s:4 * (s + m)]))
                if ids:
                    held.append(bytes(four[4 * s:4 * (s + m)]))
            rows = pa.array(of)
            cols = [b.column("doc_id").take(rows), b.column("source").take(rows), p.field("start"), p.field("length"), pa.array(crcs, pa.int64()),
                    b.column("n").take(rows), p.field("sequence_id"), p.field("offset"), p.field("round")] + [pa.array(held, pa.binary())] * ids
            yield pa.RecordBatch.from_arrays(cols, names)
        release()

    joined = tokens.select("row", "doc_id", "source", "n", "wide", "ids").join(pieces, "row")
    head = [T.StructField(c, tokens.schema[c].dataType) for c in ("doc_id", "source")]
    tail = T._parse_datatype_string(_PIECE).fields + [T.StructField("ids", T.BinaryType())] * ids
    return joined.select("doc_id", "source", "n", "wide", "ids", "pieces").mapInArrow(task, T.StructType([*head, *tail]))


def sequences(pieces: DataFrame, length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences of ``pack(..., ids=True)``, padded with ``closing`` unless they are a power of two long."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32)
                even = len(ids) & (len(ids) - 1) == 0
                out.append(ids if even else np.concatenate([ids, np.full(length - len(ids), closing, np.int32)]))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), b.column("n_tokens"), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "ids"])

    made = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return made.mapInArrow(task, "sequence_id long, n_tokens long, ids array<int>")


def mixture(pieces: DataFrame, width: int = WINDOW // LENGTH) -> DataFrame:
    """(stretch, source, tokens, share): the mix of every ``width`` sequences."""
    by = pieces.groupBy(F.expr(f"sequence_id div {width}").alias("stretch"), "source").agg(F.sum("length").alias("tokens"))
    total = by.groupBy("stretch").agg(F.sum("tokens").alias("all"))
    return by.join(total, "stretch").select("stretch", "source", "tokens", (F.col("tokens") / F.col("all")).alias("share"))

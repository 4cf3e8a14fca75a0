"""Merkle dataset manifest: postorder append logs with closed-form addresses.

Every row is a leaf; the leaves of a group (``source``) are ordered by id and
form one ternary tree, the roots of the groups form another one.  A tree with n
leaves has ceil(n / 3^l) nodes on level l: node j of a level is the hash of the
(up to) three nodes 3j, 3j + 1, 3j + 2 below it.

Trees are cut into aligned blocks of 3^``HEIGHT`` leaves.  A builder takes one
block and appends every node to the block's log as soon as it is complete:
leaves as they come, a parent behind its last child, open runs at the end.  The
roots of the blocks are the leaves of the next tier, until every tree is one
block.  So no task ever holds more than one block, however large a group is,
and there are as many tiers as the tree has levels over ``HEIGHT``.

The log needs no index.  With e = min((j + 1) * 3^l, n) leaves read when node
(l, j) is complete, all ceil(e / 3^m) nodes of the levels m <= l and the
floor((e - 1) / 3^m) closed ones of the levels m > l stand in the log up to
it, which gives its position (``position``).  Proofs are read off the log at the positions of the siblings; the
part of a proof above a block is found once a block and handed down.

Defined cases: a null field is written as ``-``; null groups and null ids come
first; rows that repeat an id are ordered by their leaf, and wholly equal rows
are interchangeable; a null id counts as the empty text where crc32 chooses
rows; empty and very long texts are leaves like any other; an empty table has
no rows and no root.  Columns outside the five fields are ignored, whatever
their names are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import crc32_of_id, lookup, ranked
from broadsheet.session import cut_lineage

ARITY = 3
HEIGHT = 6  # a builder's block has up to 3^6 = 729 leaves
HEX = 64  # a digest as text
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    """The leaf digest (32 bytes) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*map(encoded, fields)), 256))


def levels(n: int) -> int:
    """Height of the tree over n leaves."""
    h = 0
    while ARITY ** h < n:
        h += 1
    return h


def position(level: int, index: np.ndarray, n: int, height: int) -> np.ndarray:
    """Place in the log of a tree (or block) of ``n`` leaves of the nodes ``index`` of a level."""
    e = np.minimum((np.asarray(index, np.int64) + 1) * ARITY ** level, n)
    at = np.full(len(e), -1, np.int64)
    for m in range(height + 1):
        at += -(-e // ARITY ** m) if m <= level else (e - 1) // ARITY ** m
    return at


def append_log(leaves: list[bytes], height: int) -> bytes:
    """All nodes over the leaves (hex digests) in the order in which they are completed."""
    log, runs = [], [[] for _ in range(height + 1)]

    def done(level: int, digest: bytes) -> None:
        log.append(digest)
        runs[level].append(digest)
        if len(runs[level]) == ARITY and level < height:
            close(level)

    def close(level: int) -> None:
        parent = hashlib.sha256(b"".join(runs[level])).hexdigest().encode()
        runs[level].clear()
        done(level + 1, parent)

    for digest in leaves:
        done(0, digest)
    for level in range(height):
        if runs[level]:
            close(level)
    return b"".join(log)


def block_levels(log: bytes, n: int, height: int) -> list[bytes]:
    """Per level below the block's root its nodes side by side, read off the log by address."""
    nodes = np.frombuffer(log, np.uint8).reshape(-1, HEX)
    return [nodes[position(k, np.arange(-(-n // ARITY ** k)), n, height)].tobytes() for k in range(height)]


def siblings(rows: list[bytes], i: int) -> Iterator[tuple[bytes, bytes]]:
    """Per level, the nodes left and right of leaf i's ancestor in its run."""
    for row in rows:
        first = i - i % ARITY
        yield row[HEX * first:HEX * i], row[HEX * (i + 1):HEX * (first + ARITY)]
        i //= ARITY


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
    return digest




_TIER = "tree long, block long, n long, log binary, items array<struct<id:long,other:binary>>"


def _build(key: tuple, rows: pa.Table, height: int) -> pa.Table:
    rows = rows.sort_by("idx")
    digests = [x.hex().encode() for x in rows.column("digest").to_pylist()]
    n = rows.column("n")[0].as_py()
    log = append_log(digests, min(height, levels(n)))
    items = [{"id": i, "other": o} for i, o in zip(rows.column("id").to_pylist(), rows.column("other").to_pylist())]
    kinds = pa.list_(pa.struct([("id", pa.int64()), ("other", pa.binary())]))
    return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([key[1].as_py()], pa.int64()),
                     "n": pa.array([n], pa.int64()), "log": pa.array([bytes.fromhex(log.decode())], pa.binary()), "items": pa.array([items], kinds)})


def build_tiers(leaves: DataFrame, largest: int, height: int = HEIGHT) -> list[DataFrame]:
    """Blocks of all tiers of some trees, checkpointed; the last block of a tree holds its root.

    ``leaves``: (tree, n, idx, digest, id, other), idx from 0 to n - 1 in each
    tree; ``largest`` is the largest n.  A tier has one row a block: (tree,
    block, n nodes of the tree on the block's lowest level, log, items).
    """
    tiers, width = [], ARITY ** height
    while True:
        blocks = leaves.withColumn("block", F.expr(f"idx div {width}")).groupBy("tree", "block").applyInArrow(
            lambda key, rows: _build(key, rows, height), _TIER)
        tiers.append(cut_lineage(blocks))
        if largest <= width:
            return tiers
        largest = -(-largest // width)
        root = F.expr(f"substring(log, length(log) - {HEX // 2 - 1}, {HEX // 2})")
        leaves = tiers[-1].filter(F.col("n") > width).select(
            "tree", F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.col("block").alias("idx"), root.alias("digest"),
            F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("other"))


def _roots(tiers: list[DataFrame], height: int) -> DataFrame:
    """(tree, digest) of the finished trees."""
    done = [t.filter(F.col("n") <= ARITY ** height).select("tree", F.expr(f"substring(log, length(log) - {HEX // 2 - 1}, {HEX // 2})").alias("digest"))
            for t in tiers]
    return reduce(DataFrame.unionByName, done)


_PATH = "tree long, idx long, path array<struct<left:string,right:string>>, subroot string"


def _paths_below(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Of blocks with the path above them, the path of each of their lowest nodes."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for r in _rows(batches):
        rows, up = _block(r, height)
        n = _width(r, height)
        first = r["block"] * ARITY ** height
        paths = [[{"left": a.decode(), "right": z.decode()} for a, z in siblings(rows, i)] + up for i in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                                          pa.array(paths, kind), pa.array([r["subroot"]] * n, pa.string())], ["tree", "idx", "path", "subroot"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one at a time: only one is unpacked to Python objects."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _width(r: dict, height: int) -> int:
    """Nodes on the lowest level of a block."""
    return int(min(ARITY ** height, r["n"] - r["block"] * ARITY ** height))


def _block(r: dict, height: int) -> tuple[list[bytes], list]:
    """(nodes per level, path above) of a block."""
    return block_levels(r["log"].hex().encode(), _width(r, height), min(height, levels(r["n"]))), r["path"] or []


def _with_paths(tiers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The lowest blocks with ``path`` and ``subroot``; ``above`` has (tree, path, subroot) of every tree."""
    top = above.select("tree", "path", "subroot")
    for k, tier in reversed(list(enumerate(tiers))):
        last = F.col("n") <= ARITY ** height
        blocks = tier.filter(last).join(top, "tree")
        if k + 1 < len(tiers):
            blocks = blocks.unionByName(tier.filter(~last).join(inner.withColumnRenamed("idx", "block"), ["tree", "block"]))  # noqa: F821
        if k == 0:
            return blocks
        inner = cut_lineage(blocks.mapInArrow(lambda batches: _paths_below(batches, height), _PATH))


@dataclass
class Manifest:
    """Logs of the group trees and of the tree over them; ``root`` is None for an empty table."""

    groups: DataFrame  # (source, tree, n): the groups in order
    tiers: list[DataFrame]  # blocks of the group trees
    top: list[DataFrame]  # blocks of the tree over the groups' roots
    n_groups: int
    root: str | None
    height: int = HEIGHT


def build(docs: DataFrame, other: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs`` (the five ``FIELDS``), one tree a source.

    ``other`` may give a second digest per row that is carried along for
    ``proofs``, say of a row as it is found now.
    """
    leaves = cut_lineage(docs.select("source", "doc_id", leaf([F.col(c) for c in FIELDS]).alias("digest"),
                                     (F.lit(None).cast("binary") if other is None else other).alias("other")))
    leaves = leaves.withColumn("row", F.monotonically_increasing_id()).withColumn("name", encoded(F.col("source")))  # of stored rows
    rows = ranked(leaves, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.col("digest"), F.col("row")], "rank")
    groups = cut_lineage(rows.groupBy("name").agg(F.first("source").alias("source"), F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")))
    groups = ranked(groups, [F.col("first")], "tree")
    total, largest, n_groups = groups.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()
    stats = groups.select("name", "tree", "first", "n", F.col("n").alias("size"))
    placed = lookup(rows, stats, "name", "size", F.col("row"), total or 0)
    tiers = build_tiers(placed.select("tree", "n", (F.col("rank") - F.col("first")).alias("idx"), "digest", F.col("doc_id").alias("id"), "other"), largest or 0, height)
    roots = _roots(tiers, height).select(F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("idx"), "digest",
                                 F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("other"))
    top = build_tiers(roots, n_groups, height)
    root = _roots(top, height).select(F.lower(F.hex("digest"))).first()
    return Manifest(groups.select("source", "tree", "n"), tiers, top, n_groups, root and root[0], height)


def _explode_log(batches: Iterator[pa.RecordBatch], tier: int, size: int) -> Iterator[pa.RecordBatch]:
    for r in _rows(batches):
        n, height = _width(r, size), min(size, levels(r["n"]))
        full, low = levels(r["total"]), tier * size
        nodes = [r["log"][k:k + HEX // 2] for k in range(0, len(r["log"]), HEX // 2)]
        for k in range(1 if tier else 0, height + 1):  # the lowest nodes of a higher tier stand in the tier below
            local = np.arange(-(-n // ARITY ** k))
            index = local + r["block"] * ARITY ** (size - k)
            at = position(low + k, index, r["total"], full)
            digests = [nodes[p].hex() for p in position(k, local, n, height)]
            yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(local), pa.int64()), pa.array(at, pa.int64()),
                                              pa.array([low + k] * len(local), pa.int32()), pa.array(index, pa.int64()), pa.array(digests, pa.string())],
                                             ["tree", "position", "level", "index", "digest"])


def log(m: Manifest) -> DataFrame:
    """(tree, position, level, index, digest) of every node; tree -1 is the one over the groups."""
    def nodes(tiers: list[DataFrame], totals: DataFrame) -> Iterator[DataFrame]:
        for k, tier in enumerate(tiers):
            rows = tier.join(totals, "tree").select("tree", "block", "n", "log", "total")
            yield rows.mapInArrow(lambda batches, k=k: _explode_log(batches, k, height), "tree long, position long, level int, index long, digest string")

    spark, height = m.groups.sparkSession, m.height
    top = nodes(m.top, spark.range(1).select(F.col("id").alias("tree"), F.lit(m.n_groups).cast("long").alias("total")))
    parts = [*nodes(m.tiers, m.groups.select("tree", F.col("n").alias("total"))), *[t.withColumn("tree", F.lit(-1).cast("long")) for t in top]]
    return reduce(DataFrame.unionByName, parts)


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(m: Manifest) -> DataFrame:
    """Per row its leaf, the roots, the hash of its proof and the root that the row (``other`` where given) folds to."""
    root, height = m.root, m.height

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            rows, up = _block(r, height)
            above = [(p["left"].encode(), p["right"].encode()) for p in up]
            tail = b"".join(a + z for a, z in above)
            own = r["log"].hex().encode()
            n = _width(r, height)
            at = position(0, np.arange(n), n, min(height, levels(r["n"]))).tolist()
            out = []
            for i, item in enumerate(r["items"]):
                path = list(siblings(rows, i))
                proof = hashlib.sha256(b"".join(a + z for a, z in path) + tail).hexdigest()
                digest = own[HEX * at[i]:HEX * (at[i] + 1)]
                found = digest if item["other"] is None else item["other"].hex().encode()
                folded = fold(found, path + above).decode()
                out.append((item["id"], digest.decode(), r["subroot"], root, proof, folded, folded == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), *[pa.string()] * 5, pa.bool_()])],
                                             ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    spark = m.groups.sparkSession
    start = spark.range(1).select(F.col("id").alias("tree"), F.array().cast("array<struct<left:string,right:string>>").alias("path"),
                                  F.lit(None).cast("string").alias("subroot"))
    below = _with_paths(m.top, start, height).mapInArrow(lambda batches: _paths_below(batches, height), _PATH)  # one row a group
    subroots = _roots(m.tiers, height).select("tree", F.lower(F.hex("digest")).alias("own"))
    above = cut_lineage(below.select(F.col("idx").alias("tree"), "path").join(subroots, "tree").withColumnRenamed("own", "subroot"))
    return _with_paths(m.tiers, above, height).mapInArrow(task, _PROOF)


def without_newlines() -> Column:
    """Leaf of a row whose text lost its newline characters, where 2 divides crc32 of the id; null elsewhere."""
    fields = [F.replace(F.col("text"), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    return F.when((crc32_of_id(F.col("doc_id")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n")), leaf(fields))


def tamper_check(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``docs`` held against rows with newlines deleted (``without_newlines``)."""
    return proofs(build(docs, without_newlines(), height))

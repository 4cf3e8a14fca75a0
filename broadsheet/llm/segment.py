"""Sampled SentencePiece segmentation: forward filtering, backward sampling.

The lattice of a text has a node between any two characters and an edge for
every vocabulary piece that spans two nodes; a character no piece covers gets a
chain of byte pieces.  Texts are cut into pre-tokens (an optional blank and the
run behind it, or one blank character) wherever no piece of the vocabulary has
the two characters at the border side by side; where one has, the pre-tokens
stay together (runs of blanks and the word behind, a carriage return and what
precedes it).  So no piece crosses a cut, the lattice of a text is a chain of
small ones and each distinct pre-token is filtered once.

Forward filtering sums the weight of all segmentations up to each node.
Backward sampling walks from the end and draws each edge with its posterior
probability, so a segmentation comes up as often as its share of the total
weight, to the 24 bits of a draw.  Draws come from a counter hash of (seed, row
key, pre-token number, step): they do not depend on partitions or order, and
reruns agree.

Weights: the vocabulary is ranked, piece k (0 first) has weight
(k + ``shift``) ** -``alpha``; a larger alpha prefers frequent pieces more.

Decoding is lossless for every text: blanks are the pieces' U+2581, a literal
U+2581 and all uncovered characters go through byte pieces, nothing is
normalised and no blank is added.

Pre-tokens longer than ``LONG`` (runs of blanks, unbroken text) are filtered in
stretches of ``STRETCH`` characters, with the same draws, so memory stays that of the text.

Defined cases: null and empty texts have no pieces (null stays null when
decoded); texts of any length are one row, whatever they hold; columns named
like those added (pieces, decoded) are replaced, all others kept; a null key counts as the key 0; rows that repeat key and text get
the same pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.blocks import C1, IntTable, mix, release, slices, string_array, take_ranges

PRE_TOKEN = r"(?: ?[^\s]+|\s)"
BLANK = "▁"
LITERAL = 0x110000  # stands for a U+2581 of the text itself
MAX_NODES = 1_200_000  # lattice nodes a worker keeps before it starts anew
BATCH = 1 << 15  # characters of pre-tokens filtered at once
LONG = 200  # pre-tokens of more characters are not kept
STRETCH = 4096  # characters of a long pre-token filtered at once
LEAST, MOST = 1e-290, 1e290  # bounds of weights and of their ratios


def pre_tokens(pieces: list[str]) -> re.Pattern:
    """Pattern of the pre-tokens of a text that no piece crosses the border of."""
    before: dict[str, set[str]] = {}
    for piece in pieces:
        ends = [m.end() for m in re.finditer(PRE_TOKEN, piece)]
        for k in ends[:-1]:
            before.setdefault(piece[k - 1], set()).add(piece[k])
    alike: dict[str, list[str]] = {}
    for a, follow in sorted(before.items()):
        alike.setdefault("".join(sorted(follow)), []).append(a)
    some = lambda chars: "[" + "".join(map(re.escape, chars)) + "]"
    joints = "|".join(f"(?={some(follow)})(?<={some(chars)})" for follow, chars in alike.items())
    return re.compile(f"{PRE_TOKEN}(?:(?:{joints}){PRE_TOKEN})*+" if joints else PRE_TOKEN)


def model_path() -> str:
    """The 32k BPE model with byte fallback of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, byte pieces and weights of a SentencePiece model (its serialised bytes), with a trie of the pieces (edge key: node * 2^21 + character)."""

    def __init__(self, proto: bytes, alpha: float = 1.0, shift: float = 10.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte fallback")
        self.size = sp.get_piece_size()
        self.bytes_of = [b""] * self.size
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.weight = np.zeros(self.size)
        self.byte_weight = -alpha * math.log(len(plain) + shift)
        step: dict[int, int] = {}
        ends = {}
        for k, i in enumerate(plain):
            piece, at = sp.id_to_piece(i), 0
            self.weight[i] = -alpha * math.log(k + shift)
            self.bytes_of[i] = piece.replace(BLANK, " ").encode()
            for c in piece:
                at = step.setdefault((at << 21) + ord(c), len(step) + 1)
            ends[at] = i
        self.piece_at = np.full(len(step) + 1, -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        self.linear = np.maximum(np.exp(self.weight), LEAST)
        self.longest = max([1, *[len(sp.id_to_piece(i)) for i in plain]])
        self.steps = IntTable(np.fromiter(step, np.int64, len(step)))  # node k + 1 is behind the k-th edge

        self.pre_token = pre_tokens([sp.id_to_piece(i).replace(BLANK, " ") for i in plain])
        self.spelled = np.frombuffer(b"".join(self.bytes_of) + b"\0", np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes_of])
        self.spelled_to = np.cumsum(self.lengths)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        """The texts of piece lists ids[offs[i]:offs[i + 1]]; bytes that are no UTF-8 become U+FFFD."""
        to = self.spelled_to[ids]
        raw, at = take_ranges(self.spelled, to - self.lengths[ids], to)
        out = string_array(raw, at[offs])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[offs], at[offs][1:])], pa.string())
        return out

    def follow(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Next trie node per (node, character), 0 where there is none."""
        return self.steps.find((nodes.astype(np.int64) << 21) + chars) + 1


class Lattices:
    """Backward sampling tables of the pre-tokens seen so far.

    Node n stands behind one character; its edges begin at ``edge[n]``, longest
    piece first, with ``upto`` their cumulated posterior (1 at the last).  ``back``
    is the node an edge comes from, -1 at the start of a pre-token.  Pieces from
    ``v.size`` on stand for the byte chain of a character.  Pre-tokens of more
    than ``LONG`` characters are not kept here (``_drawn_long``).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.chains: dict[int, int] = {}
        self.chain_ids: list[list[int]] = []
        self.clear()

    def clear(self) -> None:
        self.nodes, self.edges, self.end = 0, 0, {}
        self.upto, self.back, self.piece = np.zeros(1 << 16, np.float32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.edge = np.zeros(1 << 15, np.int32)

    def _chain(self, char: int) -> int:
        """The piece number that stands for the bytes of a character no piece spells."""
        if char not in self.chains:
            raw = (BLANK if char == LITERAL else chr(char)).encode("utf-8", "surrogatepass")
            self.chains[char] = self.v.size + len(self.chain_ids)
            self.chain_ids.append([self.v.byte[b] for b in raw])
        return self.chains[char]

    def _spans(self, chars: np.ndarray, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, pieces, weights) of all lattice edges, by length from 1 on; ``left``: characters from each to its pre-token's end."""
        v, found = self.v, []
        live, state, k = np.arange(len(chars)), np.zeros(len(chars), np.int32), 0
        while live.size:
            state = v.follow(state, chars[live + k])
            p = np.where(state > 0, v.piece_at[state], -1)
            hit = p >= 0
            start, piece = live[hit], p[hit]
            weight = v.linear[piece]
            if k == 0 and len(start) < len(live):
                bare = live[~hit]
                p = np.array([self._chain(int(c)) for c in chars[bare]], np.int32)
                size = np.array([len(self.chain_ids[x - v.size]) for x in p], float)
                start, piece = np.concatenate([start, bare]), np.concatenate([piece, p])
                weight = np.concatenate([weight, np.maximum(np.exp(size * v.byte_weight), LEAST)])
            found.append((start, piece, weight))
            on = (state > 0) & (left[live] > k + 1)
            live, state, k = live[on], state[on], k + 1
        while not len(found[-1][0]):
            found.pop()
        return found

    def _codes(self, text: str) -> np.ndarray:
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        return np.where(chars == ord(BLANK), LITERAL, np.where(chars == 0x20, ord(BLANK), chars))

    def add(self, tokens: list[str]) -> None:
        """Filter the lattices of new pre-tokens forward, about ``BATCH`` characters at a time."""
        tokens.sort(key=len, reverse=True)
        first, held = 0, 0
        for k, t in enumerate(tokens):
            held += len(t)
            if held >= BATCH:
                self._add(tokens[first:k + 1])
                first, held = k + 1, 0
        if first < len(tokens):
            self._add(tokens[first:])

    def _add(self, tokens: list[str]) -> None:
        """Filter pre-tokens, longest first.  Nodes are laid out by character: those of one position are neighbours, in the order of the tokens."""
        size = np.array([len(t) for t in tokens])
        codes, begin = self._codes("".join(tokens)), np.cumsum(size) - size
        width = np.searchsorted(-size, -np.arange(size[0]))  # tokens with a character at each position
        off = np.concatenate([[0], np.cumsum(width)])
        pos = np.repeat(np.arange(len(width)), width)
        word = np.arange(len(codes)) - off[pos]
        node_of = np.zeros(len(codes), np.int64)  # by place in the joined text
        node_of[begin[word] + pos] = np.arange(len(codes))
        spans = [(start, node_of[start + k], piece, weight) for k, (start, piece, weight)
                 in enumerate(self._spans(codes, np.repeat(begin + size, size) - np.arange(len(codes))))]
        share = np.zeros((len(spans), len(codes)))
        for k, (_, node, _, weight) in enumerate(spans):
            share[k, node] = weight
        recent = np.zeros((len(spans), len(tokens)))  # forward weights of the nodes before, as multiples of the last
        recent[0] = 1.0
        for a, z in zip(off, off[1:]):
            s = share[:, a:z]
            s *= recent[:, :z - a]
            total = s.sum(axis=0)
            s /= total
            recent[1:, :z - a] = np.minimum(recent[:-1, :z - a] / total, MOST)
            recent[0] = 1.0
        count = sum(np.bincount(node, minlength=len(codes)) for _, node, _, _ in spans)
        need = self.edges + int(count.sum())
        if need > len(self.upto):
            self.upto, self.back, self.piece = (np.concatenate([x, np.zeros(need * 5 // 4 - len(x), x.dtype)]) for x in (self.upto, self.back, self.piece))
        if self.nodes + len(codes) > len(self.edge):
            self.edge = np.concatenate([self.edge, np.zeros((self.nodes + len(codes)) * 5 // 4 - len(self.edge), np.int32)])
        at = np.cumsum(count) - count + self.edges  # next free place of each node
        self.edge[self.nodes:self.nodes + len(codes)] = at
        upto = np.zeros(len(codes))
        for k in reversed(range(len(spans))):
            start, node, piece, _ = spans[k]
            here = at[node]
            at[node] += 1
            upto[node] += share[k, node]
            self.upto[here] = upto[node] if k else 1.0
            before = pos[node] > k
            self.back[here] = np.where(before, self.nodes + node_of[start - before], -1)
            self.piece[here] = piece
        self.end.update(zip(tokens, (self.nodes + off[size - 1] + np.arange(len(tokens))).tolist()))
        self.nodes, self.edges = self.nodes + len(codes), need

    def _drawn_long(self, token: str, stream: np.uint64) -> np.ndarray:
        """Pieces of one sampled segmentation of a long pre-token, last first.

        It is filtered in stretches; of each only the forward weights at its
        start are kept, and backward sampling filters a stretch once more.
        """
        starts = range(0, len(token), STRETCH)
        recent = [[1.0]]
        for a in starts:
            *_, behind = self._stretch(token, a, recent[-1])
            recent.append(behind)
        drawn, end, u = [], len(token), []
        for a, before in zip(reversed(starts), reversed(recent[:-1])):
            weights, pieces, states, _ = self._stretch(token, a, before)
            while end > a:
                if not u:
                    u = _uniform(np.repeat(stream, STRETCH), np.arange(len(drawn), len(drawn) + STRETCH)).tolist()[::-1]
                parts = [*map(mul, weights[end - 1 - a], states[end - 1 - a])]
                x, total, upto = u.pop(), sum(parts), 0.0
                for k in range(len(parts) - 1, -1, -1):
                    if parts[k]:
                        upto += parts[k] / total
                        if np.float32(upto) > x:
                            break
                drawn.append(pieces[end - 1 - a, k])
                end -= k + 1
        return np.array(drawn, np.int32)

    def _stretch(self, token: str, a: int, recent: list[float]) -> tuple[list[list[float]], np.ndarray, list[list[float]], list[float]]:
        """Of the nodes of token[a:a + STRETCH]: weights and pieces of their edges by length, forward weights before each as multiples of the last; those behind."""
        reach, end = self.v.longest, min(a + STRETCH, len(token))
        low = max(a - reach + 1, 0)
        weights, pieces = np.zeros((end - a, reach)), np.zeros((end - a, reach), np.int32)
        for k, (start, piece, weight) in enumerate(self._spans(self._codes(token[low:end]), np.arange(end - low, 0, -1))):
            node = start + low + k - a
            mine = node >= 0
            weights[node[mine], k], pieces[node[mine], k] = weight[mine], piece[mine]
        rows, states = weights.tolist(), []
        for row in rows:
            states.append(recent)
            total = sum(map(mul, row, recent))
            recent = [1.0, *[x / total for x in recent[:reach - 1]]]
            if total < 1e-20:
                recent = [min(x, MOST) for x in recent]
        return rows, pieces, states, recent

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, offsets per text) of one sampled segmentation per text."""
        if self.nodes > MAX_NODES:
            self.clear()
        found, counts = [], []
        for t in texts:
            n = len(found)
            found += self.v.pre_token.findall(t)
            counts.append(len(found) - n)
        fresh = set(found).difference(self.end)
        long = [i for i, t in enumerate(found) if len(t) > LONG] if max(map(len, fresh), default=0) > LONG else []
        if fresh:
            self.add([t for t in fresh if len(t) <= LONG])
        first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        number = np.arange(len(found)) - np.repeat(first[:-1], counts)
        stream = mix(np.repeat(keys, counts) + (number.astype(np.uint64) + np.uint64(1)) * C1)
        steps = np.zeros(len(found), np.int64)
        apart = {i: self._drawn_long(found[i], stream[i]) for i in long}
        for i, pieces in apart.items():
            steps[i] = len(pieces)
        live = np.delete(np.arange(len(found)), list(apart)) if apart else np.arange(len(found))
        node = np.fromiter((self.end[found[i]] for i in live) if apart else map(self.end.__getitem__, found), np.int32, len(live))
        drawn, k = [], 0
        while live.size:
            u = _uniform(stream[live], k)
            e = self.edge[node]
            miss = np.flatnonzero(self.upto[e] <= u)
            while miss.size:
                e[miss] += 1
                miss = miss[self.upto[e[miss]] <= u[miss]]
            drawn.append((live, self.piece[e]))
            steps[live] += 1
            node = self.back[e]
            on = node >= 0
            live, node, k = live[on], node[on], k + 1
        end = np.cumsum(steps)
        ids = np.zeros(int(end[-1]) if len(end) else 0, np.int32)
        for k, (at, p) in enumerate(drawn):
            ids[end[at] - 1 - k] = p
        for i, pieces in apart.items():
            ids[end[i] - len(pieces):end[i]] = pieces[::-1]
        offs = np.concatenate([[0], end])[first]
        return self._spelled(ids, offs)

    def _spelled(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte chains written out."""
        at = np.flatnonzero(ids >= self.v.size)
        if not at.size:
            return ids, offs
        parts = [self.chain_ids[i - self.v.size] for i in ids[at]]
        n = np.ones(len(ids), np.int64)
        n[at] = [len(x) for x in parts]
        end = np.concatenate([[0], np.cumsum(n)])
        out = np.repeat(ids, n)
        out[np.repeat(ids >= self.v.size, n)] = np.concatenate(parts)
        return out, end[offs]


def _uniform(stream: np.ndarray, step) -> np.ndarray:
    """The draws (24 bits, below 1) of some streams at a step, or step by step."""
    x = mix(stream + np.asarray(step).astype(np.uint64) * C1)
    return (x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)


_state: dict = {}


def _lattices(proto: bytes, alpha: float, shift: float) -> Lattices:
    """The tables of this Python worker, kept between tasks."""
    key = (hash(proto), alpha, shift)
    if key not in _state:
        _state.clear()
        _state[key] = Lattices(Vocabulary(proto, alpha, shift))
    return _state[key]


def load_model(spark: SparkSession, path: str | None = None):
    """The model's bytes, read on the driver and broadcast (about half a megabyte)."""
    with open(path or model_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model=None, key: Column | None = None, seed: int = 0, alpha: float = 1.0, shift: float = 10.0,
           decoded: bool = False) -> DataFrame:
    """``docs`` plus ``pieces`` (array of int): one sampled segmentation of ``text`` per row.

    ``key`` (default the column doc_id) and ``seed`` choose the sample.  With
    ``decoded`` the pieces are decoded again in the same task, as a check or to
    save a second pass, into a column ``decoded``.
    """
    model = model or load_model(docs.sparkSession)
    key = F.col("doc_id") if key is None else key
    made = ["pieces", "decoded"] if decoded else ["pieces"]
    rows = docs.select(F.col("text").alias("__t"), F.xxhash64(F.coalesce(key.cast("long"), F.lit(0)), F.lit(seed)).alias("__k"),
                       F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in docs.columns if c not in (*made, "text")]).alias("__doc"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(model.value, alpha, shift)
        for b in slices(batches, "__t", 1 << 19):
            texts = [t or "" for t in b.column("__t").to_pylist()]
            ids, offs = lattices.sample(texts, b.column("__k").to_numpy().astype(np.int64).view(np.uint64))
            cols = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                cols.append(lattices.v.decode(ids, offs))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *made])
        lattices.clear()  # the worker may live on for other work
        release()

    kinds = {"pieces": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    out = rows.mapInArrow(task, T.StructType([*rows.schema.fields, *[T.StructField(c, kinds[c]) for c in made]]))
    return out.select(*[F.col("__t").alias("text") if c == "text" else F.col("__doc").getField(c).alias(c) for c in docs.columns if c not in made], *made)


def decode(rows: DataFrame, model=None) -> DataFrame:
    """``rows`` plus ``decoded``: the text of ``pieces`` (null for null)."""
    model = model or load_model(rows.sparkSession)
    packed = rows.select("pieces", F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "decoded"]).alias("__doc"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _lattices(model.value, 1.0, 10.0).v
        for b in batches:
            pieces = b.column("pieces")
            size = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
            texts = v.decode(pieces.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
            texts = pc.if_else(pieces.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("__doc"), texts], ["__doc", "decoded"])

    out = packed.mapInArrow(task, T.StructType([packed.schema["__doc"], T.StructField("decoded", T.StringType())]))
    return out.select(*[F.col("__doc").getField(c).alias(c) for c in rows.columns if c != "decoded"], "decoded")


def round_trip(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, n_pieces, pieces, decoded_sha256, lossless) per row: encoded, decoded and compared."""
    out = encode(docs.select("doc_id", "text"), seed=seed, decoded=True)
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.sha2("decoded", 256).alias("decoded_sha256"),
                      (F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))).alias("lossless"))

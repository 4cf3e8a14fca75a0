"""Words and hashes of Arrow text columns as numpy arrays (no per-row Python).

All functions work on slices of a batch that hold a few megabytes of text, so
memory stays bounded for any batch; one text longer than that is a slice of
its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective): spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of ``column``."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
            yield b.slice(a, z - a)
        del b
    release()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with 8 zero bytes behind, offsets) of a string column; nulls are empty."""
    column = pa.concat_arrays([pc.fill_null(column, "").cast(pa.large_string())])
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words, and per text its first word (one entry more than texts)."""
    n = int(offs[-1])
    ink = ~BLANK[data[:n]]
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = ink[edge]
    ends[edge - 1] = ink[edge - 1]
    s = np.flatnonzero(begins)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash per word; eight bytes a step, injective for words of up to eight bytes of one length."""
    n = len(data) - 8
    eight = np.ndarray((n + 1,), "<u8", data, 0, (1,))
    size = ends - starts
    h = size.astype(np.uint64) * C1
    left = np.arange(len(starts))
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    k = 0
    while left.size:
        rest = size[left] - k
        v = eight[starts[left] + k] & masks[np.minimum(rest, 8)]
        x = (h[left] ^ v) * C2
        h[left] = x ^ (x >> np.uint64(32))
        left = left[rest > 8]
        k += 8
    return mix(h)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that begin at each word (len(h) - n + 1 values)."""
    m = max(len(h) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for k in range(n if m else 0):
        out += h[k:k + m] * power(k)
    return mix(out)


def power(k: int) -> np.uint64:
    """C1 ** k modulo 2^64."""
    return np.uint64(pow(int(C1), k, 1 << 64))


def take_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of byte ranges laid end to end; ranges may overlap."""
    size = ends - starts
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)
    return data[at], offs


def string_array(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class IntTable:
    """Open-addressing table from distinct non-negative integers (below 2^62) to their positions."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.int64)
        self.mask = (1 << max(4, (len(keys) * 4).bit_length())) - 1
        self.key = np.full(self.mask + 1, -1, np.int64)
        self.value = np.zeros(self.mask + 1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while left.size:
            free = self.key[at] < 0
            self.key[at[free]] = keys[left[free]]  # of keys that want one slot the last is written
            here = self.key[at] == keys[left]
            self.value[at[here]] = left[here]
            left, at = left[~here], (at[~here] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys.astype(np.uint64) * C1
        return ((x ^ (x >> np.uint64(32))) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position per key, -1 where it is not in the table."""
        keys = np.asarray(keys, np.int64)
        at = self._slot(keys)
        found = self.key[at]
        out = np.where(found == keys, self.value[at], np.int32(-1))
        live = np.flatnonzero((found != keys) & (found >= 0))
        at = (at[live] + 1) & self.mask
        while live.size:
            found = self.key[at]
            hit = found == keys[live]
            out[live[hit]] = self.value[at[hit]]
            on = ~hit & (found >= 0)
            live, at = live[on], (at[on] + 1) & self.mask
        return out


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values[offs[i]:offs[i + 1]] per i (0 for empty ranges)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offs[1:]] - total[offs[:-1]]

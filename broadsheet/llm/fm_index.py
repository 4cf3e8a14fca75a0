"""FM-index of a word sequence: Burrows-Wheeler transform in a wavelet matrix with packed bits.

The sequence is a list of texts over integer words (from 1), separated by 0.
Suffixes are sorted by their first 16 words, which is enough for patterns of
up to 15 words; memory is one bit per word and level, a count per 64 of them,
and the suffix order.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class WaveletMatrix:
    """Occurrences of a symbol before a position, by one bit vector a level (high bit first)."""

    def __init__(self, symbols: np.ndarray):
        top = int(symbols.max()) if len(symbols) else 0
        self.levels = max(1, top.bit_length())
        self.bits, self.blocks, self.zeros = [], [], []
        starts = np.zeros(1 << self.levels, np.int64)
        every = np.arange(1 << self.levels)
        for level in range(self.levels - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(one) - one.sum()))
            ones = self._ones(-1, starts)
            starts = np.where(every >> level & 1, self.zeros[-1] + ones, starts - ones)
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.starts = starts  # where each symbol's run begins in the last level

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[k][word] + np.bitwise_count(self.bits[k][word] & below)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbols[i] before position at[i]."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(k, at)
            at = np.where(symbols >> level & 1, self.zeros[k] + ones, at - ones)
        return at - self.starts[symbols]


def _ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (high, low)."""
    return np.unique(high * (int(low.max()) + 1) + low, return_inverse=True)[1].astype(np.int64)


class FMIndex:
    """Backward search over ``seq``, with matching statistics for windows of ``window`` words (at most DEPTH - 1)."""

    def __init__(self, seq: np.ndarray, window: int):
        if not 2 <= window < DEPTH:
            raise ValueError(f"windows have 2 to {DEPTH - 1} words")
        shift = lambda r, k: np.concatenate([r[k:], np.zeros(min(k, len(r)), r.dtype)])
        by, k = {1: seq.astype(np.int64)}, 1
        while k < DEPTH:
            by[2 * k] = _ranked(by[k], shift(by[k], k))
            k *= 2
        short, at = None, 0  # ranks of the first window - 1 words
        for k in (8, 4, 2, 1):
            if window - 1 & k:
                short = by[k] if short is None else _ranked(short, shift(by[k], at))
                at += k
        self.order = np.argsort(by[DEPTH], kind="stable")
        self.window, self.seq = window, seq
        self.bwt = WaveletMatrix(seq[self.order - 1])
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq))])
        short = short[self.order]
        head = np.concatenate([[0], np.flatnonzero(short[1:] != short[:-1]) + 1])
        size = np.diff(np.append(head, len(short)))
        self.low, self.high = np.repeat(head, size), np.repeat(head + size, size)

    def step(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of word + pattern from the interval of the pattern."""
        return self.before[words] + self.bwt.rank(words, lo), self.before[words] + self.bwt.rank(words, hi)

    def matches(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, hi) per position of the sequence: the suffixes that begin with the window there.

        The texts seq[starts[i]:ends[i]] are streamed from their last word to
        the first, all at once: each step drops the last word of a full window
        (back to the interval of the rest) and takes one word more in front.
        Positions where no window begins keep an empty interval.
        """
        at, lo, hi = ends.astype(np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), len(self.seq), np.int64)
        out_lo, out_hi = np.zeros(len(self.seq), np.int64), np.zeros(len(self.seq), np.int64)
        live, taken = np.flatnonzero(at > starts), 0
        while live.size:
            at[live] -= 1
            a, b = lo[live], hi[live]
            if taken >= self.window:
                a, b = self.low[a], self.high[a]
            lo[live], hi[live] = self.step(self.seq[at[live]], a, b)
            taken += 1
            if taken >= self.window:
                out_lo[at[live]], out_hi[at[live]] = lo[live], hi[live]
            live = live[at[live] > starts[live]]
        return out_lo, out_hi

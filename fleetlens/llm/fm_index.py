"""A compressed full-text index over integer symbols: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Suffixes are sorted by their first ``depth`` symbols, which is enough for patterns of up to ``depth`` symbols. All
patterns of a search go on together, one symbol at a time.
"""

from __future__ import annotations

import numpy as np


def _rank_pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of dense ranks."""
    return np.unique(high.astype(np.int64) * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1]


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by] + 1, or 0 past the end."""
    out = np.zeros(len(x), np.int64)
    if by < len(x):
        out[:-by] = x[by:] + 1
    return out


class WaveletMatrix:
    """Bit planes of the symbols, highest first, each stably parted by its bit; counts of ones per 64 bits."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.before, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level & 1).astype(bool)
            padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int32), dtype=np.int32)])
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[~bits], now[bits]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` places end up after parting, among those of ``symbol``."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where(symbol >> level & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int):
        """text: non-negative symbols."""
        rank, have = np.unique(text, return_inverse=True)[1], 1
        ranks = {1: rank}
        while have * 2 <= depth:
            rank = _rank_pairs(rank, _shift(rank, have))
            have *= 2
            ranks[have] = rank
        for part in sorted(ranks, reverse=True):
            if have + part <= depth:
                rank = _rank_pairs(rank, _shift(ranks[part], have))
                have += part
        self.order = np.argsort(rank, kind="stable")
        self.last = text[self.order - 1]  # the place before the first is the text's end
        self.matrix = WaveletMatrix(self.last)
        counts = np.bincount(text)
        self.start = np.r_[0, np.cumsum(counts)]
        symbols = np.arange(len(counts))
        self.base = self.matrix.descend(symbols, np.zeros(len(counts), np.int64))

    def search(self, text: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high): suffix intervals of more than one place of the patterns text[at : at + size].

        A pattern whose interval shrinks to one place, itself, is dropped on the way.
        """
        which = np.arange(len(at))
        symbol = text[at + size - 1]
        low, high = self.start[symbol], self.start[symbol + 1]
        for k in range(size - 2, -1, -1):
            on = high - low > 1
            which, low, high = which[on], low[on], high[on]
            symbol = text[at[which] + k]
            base = self.start[symbol] - self.base[symbol]
            low, high = base + self.matrix.descend(symbol, low), base + self.matrix.descend(symbol, high)
        on = high - low > 1
        return which[on], low[on], high[on]

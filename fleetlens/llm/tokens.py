"""Words of Arrow batches as NumPy arrays: offsets and 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of a UTF-8 text; a null text has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit words."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Longer words are hashed one by one by BLAKE2b, shorter ones all together by blocks of eight bytes.
LONG = 256


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of every range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class Words:
    """data: bytes of all texts; start, end: bytes of each word; doc: its text; first: index of each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """Hash of each word, equal for equal bytes wherever the word stands.

        Each block of eight bytes is scrambled into the hash of those before it, which depends on their order in no simple
        (polynomial) way; words of the same letters in some pattern do not meet.
        """
        n = len(self.start)
        if not n:
            return np.zeros(0, U)
        data = np.concatenate([_FOLD[self.data] if lower else self.data, np.zeros(8, np.uint8)])
        blocks = np.lib.stride_tricks.sliding_window_view(data, 8)
        length = self.end - self.start
        out = mix(length.astype(U) * U(BASE))
        some, at = np.flatnonzero(length <= LONG), 0
        while len(some):
            block = np.ascontiguousarray(blocks[self.start[some] + at]).view("<u8")[:, 0]
            left = np.minimum(length[some] - at, 8).astype(U)
            block &= ~U(0) >> (U(64) - left * U(8))
            out[some] = mix((out[some] ^ mix(block + U(BASE))) * U(BASE))
            at += 8
            some = some[length[some] > at]
        for k in np.flatnonzero(length > LONG):
            word = data[self.start[k] : self.end[k]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, person=b"long word").digest(), "little")
        return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offset of each row (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), offsets - (offsets[0] if len(offsets) else 0)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~SPACE[data]
    if not len(solid):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cut] = solid[cut]
    ends[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text at most (one longer text makes a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words_of(batch: pa.RecordBatch, column: str) -> Words:
    return split_words(*column_bytes(batch.column(column)))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on (positions run over text ends; the caller masks those)."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, U)
    for j in range(n):
        out = out * U(BASE) + hashes[j : j + size]
    return mix(out)


def grams_within(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of each n-gram that lies within one text."""
    size = max(0, len(hashes) - n + 1)
    doc = words.doc
    inside = doc[:size] == doc[n - 1 : n - 1 + size]
    at = np.flatnonzero(inside)
    return grams(hashes, n)[at], at

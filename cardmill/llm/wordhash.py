"""Words of whole Arrow text columns as numpy arrays: normalised bytes, word bounds and 64-bit word hashes.

Lower-casing and the choice of separators are a 256-entry byte table, so UTF-8 stays UTF-8: bytes of 0x80 and above are
always part of a word. The hash of a word is the same in every process; it depends on its normalised bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 500_000
SPACE = 32


def _byte_table() -> np.ndarray:
    table = np.full(256, SPACE, dtype=np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


#: Byte to normalised byte: A-Z lower-cased; digits, letters and non-ASCII kept; everything else a space.
BYTE_TABLE = _byte_table()
TRANSLATION = BYTE_TABLE.tobytes()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, element by element (uint64 in and out)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _STEP)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return row(_BASE), row(_INVERSE)


@dataclass
class Words:
    """Words of the documents ``first`` .. ``first + n_docs - 1`` of a column."""

    first: int
    n_docs: int
    data: np.ndarray  # normalised bytes of these documents, one after the other
    starts: np.ndarray  # byte bounds of each word in data
    ends: np.ndarray
    docs: np.ndarray  # document of each word, counted from 0 in this chunk
    hashes: np.ndarray  # uint64

    def per_doc(self) -> np.ndarray:
        """Words of each document."""
        return np.bincount(self.docs, minlength=self.n_docs)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes; a longer document is a range of its own."""
    low = 0
    while low < len(offsets) - 1:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = max(high, low + 1)
        yield low, high
        low = high


def word_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a text column, some documents at a time; every document is whole in one chunk."""
    data, offsets = text_buffers(column)
    for low, high in doc_chunks(offsets, limit):
        own = BYTE_TABLE[data[offsets[low] : offsets[high]]]
        bounds = offsets[low : high + 1] - offsets[low]
        inside = own != SPACE
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(own):
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[bounds[:-1][bounds[:-1] < len(own)]] = False  # words end with their document
            after[bounds[1:][bounds[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        size = max(limit, len(own)) + 1
        up, down = _powers(1 << (size - 1).bit_length() if size > limit + 1 else size)
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[own] * up[: len(own)], dtype=np.uint64, out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
        docs = np.searchsorted(bounds, starts, "right") - 1
        yield Words(low, high - low, own, starts, ends, docs, hashes)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of ``size`` words; a document with fewer words, but not none, is one shingle."""
    counts = words.per_doc()
    first = np.concatenate(([0], np.cumsum(counts)))
    n = len(words.hashes)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    room = first[words.docs + 1] - np.arange(n)  # words from here to the end of the document
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        live = room > k
        total[live] = mix64(total[live] + words.hashes[np.flatnonzero(live) + k] + _STEP)
    starts_short = (counts[words.docs] < size) & (np.arange(n) == first[words.docs])
    use = (room >= size) | starts_short
    return total[use], words.docs[use]

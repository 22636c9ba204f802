"""Words of Arrow text batches as flat numpy arrays, and 64-bit hashes of words and windows.

A word is a run of bytes that are none of space, tab, line feed, vertical tab, form feed and
carriage return. All arrays of one block share the order of the words; a document's words are
``first[d] : first[d + 1]``.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at a time; a longer document makes a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed constants): spreads the bits of 64-bit values."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of words and of windows of words; another seed gives an independent hash."""

    def __init__(self, seed: int = 1, lower: bool = False):
        with np.errstate(over="ignore"):
            keys = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1_000_003))
            self.base = int(mix(np.array([seed], np.uint64))[0]) | 1
        if lower:
            keys[65:91] = keys[97:123]
        self.keys = keys
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The base and its inverse, raised to 0 .. n - 1 (mod 2**64)."""
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each ``values[start:end]``, the same wherever the span lies."""
        up, down = self.powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


class Block:
    """Some documents of a batch: their rows, bytes and words."""

    def __init__(self, rows: slice, data: np.ndarray, bounds: np.ndarray):
        self.rows, self.data, self.bounds = rows, data, bounds
        n = len(data)
        solid = ~_SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[bounds[:-1]] = True
        head = solid.copy()
        head[1:] &= ~solid[:-1] | begins[1:n]
        tail = solid.copy()
        tail[:-1] &= ~solid[1:] | begins[1:n]
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.n_words = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Document (within the block) of each word."""
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def hashes(self, hasher: Hasher) -> np.ndarray:
        return hasher.spans(hasher.keys[self.data], self.start, self.end)

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of so many words that lie in one document."""
        left = np.repeat(self.first[1:], self.n_words) - np.arange(len(self.start))
        return np.flatnonzero(left >= size)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: none) and the bounds of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] \
        if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


# Bytes with ASCII punctuation read as spaces.
BARE = np.array([32 if chr(b) in string.punctuation else b for b in range(256)], np.uint8)


def blocks(
    texts: pa.Array, limit: int = BLOCK_BYTES, read_as: np.ndarray | None = None,
) -> Iterator[Block]:
    """Cut a column of texts into blocks of about ``limit`` bytes, between documents. With
    ``read_as`` each byte is replaced first."""
    data, bounds = text_buffers(texts)
    if read_as is not None:
        data = read_as[data]
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield Block(slice(at, to), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def ragged(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """List column from sizes and flat values."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

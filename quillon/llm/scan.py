"""Words of Arrow texts as numpy arrays: spans and 64-bit hashes of all words of a batch at once, and values remembered by hash.

A word's hash is a polynomial in a random value of each byte, scrambled together with the length. Two of five million different words
collide with a chance of about one in a million, and words are held equal by hash alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quillon.llm.common import mix64, ragged

#: Bytes of texts that are worked on at once; one longer text is worked on by itself.
BLOCK_BYTES = 512 << 10
#: Texts of a block at most: keys of a block hold a text's number in 8 bits.
BLOCK_TEXTS = 256

_RANDOM = np.random.default_rng(20_240_229)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    def __init__(self):
        self.held = np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.held):
            self.held = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 256) - 1, _BASE)]))
        return self.held


powers = _Powers()


class Block:
    """Bytes of some whole texts, with the offsets of the texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def span(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()

    def per_text(self, starts: np.ndarray) -> np.ndarray:
        """How many of these ascending starts lie in each text."""
        return np.diff(np.searchsorted(starts, self.offsets))


def blocks(texts: pa.Array, lower: bool = False, size: int = BLOCK_BYTES, most: int = BLOCK_TEXTS) -> Iterator[tuple[int, int, Block]]:
    """(first, last, Block) over a column of texts, of some `size` bytes and at most `most` texts each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = min(first + most, max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1))
        part = data[offsets[first] : offsets[last]]
        yield first, last, Block(LOWER[part] if lower else part, offsets[first : last + 1] - offsets[first])
        first = last


def words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words, which never reach over the end of a text."""
    if not len(block.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[block.data]
    cut = np.zeros(len(inside) + 1, bool)
    cut[block.offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending spans without overlap, each of at least one byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.arange(int(lengths.sum())) - np.repeat(ragged(lengths)[:-1] - starts, lengths)
    values = _BYTE[data[at]]
    values *= powers(int(lengths.max()))[at - np.repeat(starts, lengths)]
    return mix64(np.add.reduceat(values, ragged(lengths)[:-1]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def polynomial(rows: np.ndarray) -> np.ndarray:
    """Hashes of rows of bytes that all have one length."""
    return mix64((_BYTE[rows] * powers(rows.shape[1])[: rows.shape[1]]).sum(axis=1, dtype=np.uint64))


EMPTY = np.uint64(0)


class HashIndex:
    """Numbers 0, 1, ... of 64-bit keys in the order they were added; open addressing in numpy."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; -1 for those that aren't held."""
        keys = np.where(keys == EMPTY, np.uint64(1), keys)
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.number[at], -1)
        todo = np.flatnonzero((held != keys) & (held != EMPTY))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.number[at[hit]]
            on = ~hit & (held != EMPTY)
            todo, at = todo[on], at[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that aren't held yet."""
        keys = np.where(keys == EMPTY, np.uint64(1), keys)
        while (self.n + len(keys)) * 2 > 1 << self.bits:
            full = self.keys != EMPTY
            old, numbers = self.keys[full], self.number[full]
            self.bits += 1
            self.keys, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(old, numbers)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = np.flatnonzero(self.keys[at] == EMPTY)
            self.keys[at[free]] = keys[todo[free]]  # of several on one slot the last stays
            won = free[self.keys[at[free]] == keys[todo[free]]]
            self.number[at[won]] = numbers[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)


class Memo:
    """Values of words seen lately by hash. compute(words as bytes) gives an array; beyond `limit` words it starts anew."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], limit: int = 600_000, join: Callable | None = None):
        self.compute, self.limit, self.join = compute, limit, join
        self.index, self.values, self.parts = HashIndex(), None, []

    def __call__(self, block: Block, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """For each span, the number of its value among self.values."""
        keys = hashes(block.data, starts, ends) if keys is None else keys
        at = self.index.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            if self.index.n and self.index.n + len(new) > self.limit:
                self.index, self.values, self.parts = HashIndex(), None, []
                return self(block, starts, ends, keys)
            spans = missing[first]
            data = block.data.tobytes()
            self._keep(self.compute([data[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist())]))
            at[missing] = self.index.n + back
            self.index.add(new)
        return at

    def _keep(self, more) -> None:
        if self.join:
            self.values = more if self.values is None else self.join(self.values, more)
            return
        n = self.index.n
        if self.values is None or n + len(more) > len(self.values):
            grown = np.zeros((max(4096, 2 * (n + len(more))), *more.shape[1:]), more.dtype)
            if n:
                grown[:n] = self.values[:n]
            self.values = grown
        self.values[n : n + len(more)] = more


def text_sums(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, per_text of them for each text; a sum depends on its own values alone."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    out, some = np.zeros((len(per_text), *values.shape[1:]), kind), per_text > 0
    if some.any():
        out[some] = np.add.reduceat(values.astype(kind, copy=False), ragged(per_text)[:-1][some], axis=0)
    return out


@lru_cache(maxsize=1)
def no_words() -> np.ndarray:
    return np.zeros(0, np.int64)

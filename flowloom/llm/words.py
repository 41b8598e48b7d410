"""Words, word hashes and word n-grams of whole Arrow text columns, with numpy.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab, form feed
and carriage return.  Texts are worked on in blocks of half a megabyte, so memory does not
follow the batch.  One longer text is a block of its own, but its words are still found and
hashed in strips of 64 KiB: beside the text only about three bytes per byte of it are held.

Arrow's pool and the C heap keep what was freed, so a worker would grow with every operator that
ran in it.  After every two megabytes of text it returns that to the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowloom.llm.common import worker_cache

BLOCK_BYTES = 512 << 10
STRIP_BYTES = 64 << 10
RETURN_BYTES = 2 << 20  # of text between two returns of freed memory
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(factor: int) -> np.ndarray:
    steps = np.full(STRIP_BYTES + 1, factor, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_FACTOR), _powers(_INVERSE)


@dataclass
class Block:
    """Some rows of a batch: ``rows`` are their places in it, ``data`` their joined bytes."""

    rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


@dataclass
class Words:
    """Hashes of all words of a block; the words of row i are ``first[i]:first[i + 1]``."""

    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def return_memory() -> None:
    """Give memory that Arrow and the C heap hold but do not use back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):  # only glibc has it
        return
    trim(ctypes.c_size_t(0))


def _worked_on(n: int) -> None:
    """Note that ``n`` bytes of text are done."""
    done = worker_cache("text_done")
    done["bytes"] = done.get("bytes", 0) + n
    if done["bytes"] >= RETURN_BYTES:
        done["bytes"] = 0
        return_memory()


def blocks(texts: pa.Array, order: np.ndarray | None = None, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks, in ``order`` if given; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if order is None:
        order = np.arange(len(texts))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)[order]
    total = np.cumsum(sizes)
    at = 0
    while at < len(order):
        before = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, before + block_bytes, side="right")))
        rows = order[at:upto]
        part = pc.fill_null(texts.take(pa.array(rows)), "").cast(pa.large_string())
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(rows) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(part.buffers()[2], np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
        yield Block(rows, data, offsets[:-1] - low, offsets[1:] - low)
        del part, offsets, data
        _worked_on(high - low)
        at = upto


def _strip_words(data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, polynomial) of every run of solid bytes in at most ``STRIP_BYTES``."""
    begin, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    return begin, end, (sums[end] - sums[begin]) * _DOWN[begin]


def words(block: Block, lower: bool = False) -> Words:
    """Hash every word of a block; ``lower`` folds A-Z first."""
    n, rows = len(block.data), len(block.starts)
    if not n:
        return Words(np.empty(0, np.uint64), np.zeros(rows + 1, np.int64))
    edges = np.unique(block.starts[block.starts < block.ends])
    begin, end, value = [], [], []
    for low in range(0, n, STRIP_BYTES):
        data = block.data[low : low + STRIP_BYTES]
        data = _LOWER[data] if lower else data
        solid = _NOT_SPACE[data]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        at = edges[np.searchsorted(edges, low) : np.searchsorted(edges, low + len(data))] - low
        begins[at] = solid[at]
        at = at[at > 0] - 1
        stops[at] = solid[at]
        for part, found in zip((begin, end, value), _strip_words(data, begins, stops), strict=True):
            part.append(found + low if part is not value else found)
    begin, end, value = (np.concatenate(x) for x in (begin, end, value))
    # Words that cross strips were hashed in parts: a later part counts from the word's first byte.
    cut = np.flatnonzero((begin[1:] == end[:-1]) & (begin[1:] % STRIP_BYTES == 0)) + 1
    cut = cut[~np.isin(begin[cut], edges)]
    if len(cut):
        whole = np.ones(len(begin), bool)
        whole[cut] = False
        root = np.maximum.accumulate(np.where(whole, np.arange(len(begin)), 0))[cut]
        for part, first in zip(cut.tolist(), root.tolist(), strict=True):
            step = pow(_FACTOR, int(begin[part] - begin[first]), 1 << 64)
            value[first] = np.uint64((int(value[first]) + int(value[part]) * step) % (1 << 64))
            end[first] = end[part]
        begin, end, value = begin[whole], end[whole], value[whole]
    value = mixed(value + mixed((end - begin).astype(np.uint64)))
    first = np.searchsorted(begin, np.append(block.starts, n))
    return Words(value, first)


def grams(hashes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n words from each place on; places less than n from the end are left out."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(_FACTOR ^ (2 * seed))
    value = np.full(count, seed, np.uint64)
    for j in range(n):
        value = value * factor + hashes[j : j + count]
    return mixed(value)


def shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-word shingles of every row, A-Z folded: (hashes, first).

    A row with fewer than n words has its whole word sequence as one shingle; a row
    without words has none.
    """
    w = words(block, lower=True)
    count = np.diff(w.first)
    row = w.row
    full = grams(w.hash, n, n)
    ends = w.first[1:][row]
    fits = np.flatnonzero(np.arange(len(full)) + n <= ends[: len(full)])
    owner, value = row[fits], full[fits]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        lone = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            part = w.hash[w.first[r] : w.first[r + 1]]
            lone[i] = grams(part, len(part), n * 100 + len(part))[0]
        owner, value = np.concatenate([owner, short]), np.concatenate([value, lone])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        owner, value = owner[keep], value[keep]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def runs(start: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive places of one owner: (index of each run's first place, run lengths)."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero((np.diff(start) != 1) | (owner[1:] != owner[:-1])) + 1
    at = np.concatenate([[0], cut])
    return at, np.diff(np.append(at, len(start)))

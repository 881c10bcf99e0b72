"""Words, lines and shingles of whole Arrow string columns as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. Those separators are single bytes in UTF-8, so words are
found in the bytes. Spans are compared by 64-bit polynomial hashes, taken from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20  # text handled at once; one longer document is handled alone
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
GRAM = np.random.default_rng(11).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            _POWERS[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, dtype=np.uint64))])
    return _POWERS


@dataclass
class Words:
    """Words of some documents. ``off[i]:off[i + 1]`` are those of document i."""

    data: np.ndarray
    doc_off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.off)

    def owner(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.count)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        return spans(self.data if data is None else data, self.start, self.end)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, past the last, bytes, offsets) of runs of documents of about ``limit`` bytes; null counts as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        if not len(chunk):
            continue
        off = np.frombuffer(chunk.buffers()[1], dtype=np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = chunk.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            upto = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield base + at, base + upto, data[off[at] : off[upto]], off[at : upto + 1] - off[at]
            at = upto
        base += len(chunk)


def find_words(data: np.ndarray, doc_off: np.ndarray) -> Words:
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[doc_off] = True
    before = np.ones(len(data), dtype=bool)
    before[1:] = ~inside[:-1]
    before |= edge[:-1]
    after = np.ones(len(data), dtype=bool)
    after[:-1] = ~inside[1:]
    after |= edge[1:]
    start = np.flatnonzero(inside & before)
    return Words(data, doc_off, start, np.flatnonzero(inside & after) + 1, np.searchsorted(start, doc_off))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def shingles(words: Words, size: int, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and their offsets by document.

    A document with fewer words, but at least one, has one shingle of all of them.
    """
    h, n = words.hashes(data), words.count
    have = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(have)])
    place = np.arange(off[-1]) + np.repeat(words.off[:-1] - off[:-1], have)
    length = np.repeat(np.minimum(n, size), have)
    total = length.astype(np.uint64) * GRAM[size]
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    for k in range(size):
        total += np.where(k < length, padded[place + k], np.uint64(0)) * GRAM[k]
    return mix(total), off


def totals(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    sums = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=bool)
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys

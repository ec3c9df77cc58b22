"""Vectorised text helpers used inside Spark tasks.

All work on flat byte arrays taken straight from Arrow string columns, so a
batch of documents is hashed with a handful of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Text bytes handled at once in a task; a longer document is handled alone.
CHUNK_BYTES = 2 << 20

_SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
IS_WORD = np.ones(256, bool)
IS_WORD[_SPACES] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls in a worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), np.uint64)
        out[0], filled = 1, 1
        while filled < len(out):
            step = min(filled, len(out) - filled)
            out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
            filled += step
        if n > 4 * CHUNK_BYTES:
            return out[:n]
        have = _powers[base] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Polynomial hashes of any ranges of a sequence."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(n), out=self.sums[1:])
        self.inverse = powers(n + 1, INVERSE)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text, at least one row each."""
    if not batch.num_rows:
        return
    sizes = np.diff(flat(batch.column(text))[1])
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def word_bounds(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each row's offsets into them."""
    inside = table[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and each row's offsets into them."""
    starts, ends, rows = word_bounds(raw, offsets, table)
    return mix(Rolling(raw).ranges(starts, ends)), starts, ends, rows


def row_of(rows: np.ndarray) -> np.ndarray:
    """The row index of each item, from row offsets."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their rows; fewer words make one shingle, none makes none."""
    counts = np.diff(rows)
    roll = Rolling(hashes)
    owner = row_of(rows)
    start = np.arange(len(hashes))
    keep = start + k <= rows[1:][owner]
    first, who = start[keep], owner[keep]
    short = np.flatnonzero((counts > 0) & (counts < k))
    begin = np.concatenate([first, rows[:-1][short]])
    end = np.concatenate([first + k, rows[1:][short]])
    return mix(roll.ranges(begin, end) ^ (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.concatenate([who, short])

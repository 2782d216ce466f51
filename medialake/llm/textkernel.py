"""Words, shingles and their 64-bit hashes over whole Arrow batches, in numpy, without a Python object per word.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; letters A-Z are lower-cased. Texts are taken whole.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset in them; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row): words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64))
    active, at, left = np.arange(len(starts)), starts, sizes
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
    while len(active):
        piece = np.ascontiguousarray(eights[at]).view(np.uint64).ravel() & masks[np.minimum(left, 8)]
        out[active] = mix(out[active] ^ piece)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, words before each row)."""
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends, rows = word_bounds(data, offsets)
    return hash_runs(data, starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of size words, shingles before each row); a row of fewer words, but one at least, has its whole
    sequence as its one shingle."""
    n = np.diff(rows)
    chain = np.zeros(len(words), np.uint64)
    for j in range(size):
        part = words[j:] if j else words
        chain[: len(part)] = mix(chain[: len(part)] ^ part)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    pick = np.arange(bounds[-1]) + np.repeat(rows[:-1] - bounds[:-1], counts)
    out = chain[pick]
    for row in np.flatnonzero((n > 0) & (n < size)):
        h = np.zeros(1, np.uint64)
        for w in words[rows[row] : rows[row + 1]]:
            h = mix(h ^ w)
        out[bounds[row]] = mix(h ^ np.uint64(n[row]))[0]
    return out, bounds


def distinct_per_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and how many stand before each row."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent where the C library is another


def hand_back() -> None:
    """Return freed memory to the system. Python workers outlive a task, and both allocators keep what its batches have freed, so
    that later stages would find an executor's memory taken."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def blocks(batches, text: str, limit: int = 4 << 20):
    """Cut record batches so that each piece has about limit bytes of text (one longer row is a piece of its own); memory that a
    batch has freed is handed back before the next is read."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        _, offsets = text_bytes(column)
        start = 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
        del batch, column, offsets
        hand_back()

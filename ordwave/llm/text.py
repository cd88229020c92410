"""Vectorised views of whole UTF-8 texts: words, lines, hashes. Small numpy helpers used inside tasks.

A word is a maximal run of bytes other than space and \\x09-\\x0D. Hashes are 64 bits and depend on
the bytes alone, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(0xD1342543DE82EF95, _LANES)
_POW_HIGH = _powers(int(_POW[-1]) * 0xD1342543DE82EF95 % 2**64, _LANES)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values; other seeds give independent orders."""
    h = h + np.uint64((seed * int(_STEP)) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class Words:
    """Word positions of a batch of texts: byte starts and ends, and `first`, the words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~WHITESPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        before &= ~edge[:-1]
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        if len(data):
            after[-1] = False
            after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.inside = inside

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each byte span; `lower` folds A-Z."""
    out = np.zeros(len(starts), np.uint64)
    size = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        done = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, done + block, "right")))
        s, length = starts[at:upto], (ends - starts)[at:upto]
        begin = np.cumsum(length) - length
        inner = np.arange(int(length.sum())) - np.repeat(begin, length)
        b = data[np.repeat(s, length) + inner]
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        v = _BYTE[b] * _POW[inner & (_LANES - 1)]
        if len(length) and length.max() >= _LANES:
            v *= _POW_HIGH[inner >> 16]
        full = length > 0
        if full.any():
            out[at:upto][full] = np.add.reduceat(v, begin[full])
        at = upto
    return mix(out + (ends - starts).astype(np.uint64) * _STEP)


def window_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of each k consecutive values of h (len(h) - k + 1 of them), in O(log k) passes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = mix(h, seed)
    mult = int(mix(np.array([seed], np.uint64), 77)[0]) | 1
    out, have, power, width = None, 0, base, 1
    bits = k
    while bits:
        if bits & 1:
            if out is None:
                out, have = power, width
            else:  # out covers the first `have` values, power the next `width`
                n = len(h) - have - width + 1
                out = out[:n] * np.uint64(pow(mult, width, 2**64)) + power[have : have + n]
                have += width
        bits >>= 1
        if bits:
            n = len(power) - width
            power = power[:n] * np.uint64(pow(mult, width, 2**64)) + power[width : width + n]
            width *= 2
    return mix(out, seed + 1)


def inside_texts(first: np.ndarray, k: int) -> np.ndarray:
    """Which word positions begin k consecutive words of one text (over len(words) - k + 1 positions)."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    return left >= k


def shingles(words: Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each k-word shingle; a text of 1 to k - 1 words has its whole sequence as one."""
    texts = words.text_of_word()
    ok = inside_texts(words.first, k)
    at = np.flatnonzero(ok)
    rows, keys = texts[at], window_hashes(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words.counts[short] > j
            value[has] = mix(value[has] + h[words.first[short][has] + j], 11 + j)
        rows = np.concatenate([rows, short])
        keys = np.concatenate([keys, mix(value, 5)])
    return rows, keys


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the machine: a worker outlives its tasks and should not keep the most that it ever held."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, text: str, size: int = 4 << 20):
    """The batch in runs of rows with about `size` bytes of text each (one row at least)."""
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(length)
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(at, upto - at)
        at = upto
    give_back()

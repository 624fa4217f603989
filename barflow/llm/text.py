"""Vectorised text kernels shared by the corpus operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, so UTF-8
needs no decoding.  Every kernel works on a whole Arrow batch at once: the
string column's data buffer is read as one byte array and all word hashes
come from a handful of numpy passes, with no loop over documents or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by one Python task; bounds its memory.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        for k, base in enumerate((_ODD, inverse)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0], _POW[1]


@dataclass
class Words:
    """Words of several texts: hash, first byte and end byte of each, and where each text's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, k: int) -> slice:
        return slice(int(self.offsets[k]), int(self.offsets[k + 1]))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and its offsets, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset or len(texts) == 0:
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())]) if len(texts) else pa.array([], pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Hashes of all words of a batch of texts; lower: A-Z are lower-cased first."""
    data, off = buffer(texts)
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    left = inside.copy()
    left[1:] &= ~inside[:-1]
    cut = off[:-1][off[:-1] < n]
    left[cut] = inside[cut]  # a word never runs across two texts
    right = inside.copy()
    right[:-1] &= ~inside[1:]
    cut = off[1:][off[1:] > 0] - 1
    right[cut] = inside[cut]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(h, start, end, np.searchsorted(start, off), data)


_STEP = [mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(64)]


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries of h (none if there are fewer)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _STEP[0]
    for k in range(1, n):
        out += (h[k : k + m] ^ _STEP[k]) * _STEP[k]
    return mix(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of one text; a shorter text is one shingle, an empty one has none."""
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    if len(h) < n:
        return mix(shingles(h, len(h)) + np.uint64(len(h)))
    return np.unique(shingles(h, n))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` text bytes (one row at least)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for x, y in zip(edges, edges[1:], strict=False):
            yield b.slice(x, y - x)

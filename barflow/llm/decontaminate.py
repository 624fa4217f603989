"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size: class s holds items of s/2 to s shingles (five
words each).  Documents are laid out in windows of 1.5 s shingles that advance
by s/2, so some window covers any run of s and is little longer than the item
it may hold; MinHash minima of windows and items meet, one minimum being
enough, and every candidate is verified by exact containment: the share of
the item's distinct shingles that the whole document has.

The benchmark is the stated query set: it is taken in hash blocks of about
ITEM_BYTES bytes of items, whose index each task holds, and every block sees every
document.  Documents are read where they are; nothing of them is shuffled.

Defined results: A-Z are lower-cased; an item of fewer than five words is one
shingle that must occur as it stands; items or documents without words match
nothing; equal items each match; repeated document rows each give rows; an
empty benchmark or corpus gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, mix, shingle_set, shingles, sliced, words

N = 5
THRESHOLD = 0.75
#: Minima of an item; all must miss for it to be lost (under 1 in 10,000 for a whole item in any window it fits).
MINIMA = 32
#: Bytes of items that one pass over the documents looks for; bounds what the driver and a broadcast hold.
ITEM_BYTES = 16 << 20
RESULT = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"

_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)


def _hashed(x: np.ndarray, k: int) -> np.ndarray:
    return ((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Minima of a block of items by size class, and their exact shingle sets."""

    def __init__(self, items: list[tuple[int, str | None]]):
        w = words(pa.array([t for _, t in items], pa.string()), lower=True)
        self.ids = [k for k, _ in items]
        self.n_words = np.diff(w.offsets)
        self.sets = [shingle_set(w.hash[w.of(j)], N) for j in range(len(w))]
        self.short: dict[int, dict[int, list[int]]] = {}
        members: dict[int, list[int]] = {}
        for j, s in enumerate(self.sets):
            if 0 < self.n_words[j] < N:
                self.short.setdefault(int(self.n_words[j]), {}).setdefault(int(s[0]), []).append(j)
            elif len(s):
                members.setdefault(max(2, 1 << (len(s) - 1).bit_length()), []).append(j)
        self.classes = {}
        for size, js in sorted(members.items()):
            rows = []
            for k in range(MINIMA):
                m = np.array([_hashed(self.sets[j], k).min() for j in js], np.uint32)
                order = np.argsort(m, kind="stable")
                known = np.zeros(1 << 16, bool)
                known[m >> np.uint32(16)] = True
                rows.append((m[order], np.array(js)[order], known))
            self.classes[size] = rows

    def candidates(self, w: Words) -> set[tuple[int, int]]:
        """(text, item) pairs that share a minimum in some window, or hold a short item's hash."""
        out: set[tuple[int, int]] = set()
        for n, known in self.short.items():
            g = mix(shingles(w.hash, n) + np.uint64(n))
            for p in np.flatnonzero(np.isin(g, np.fromiter(known, np.uint64, len(known)))):
                d = int(np.searchsorted(w.offsets, p, side="right")) - 1
                if p + n <= w.offsets[d + 1]:
                    out.update((d, j) for j in known[int(g[p])])
        if not self.classes or len(w.hash) < N:
            return out
        g = shingles(w.hash, N)
        count = np.maximum(np.diff(w.offsets) - N + 1, 0)
        doc = np.flatnonzero(count)
        if not len(doc):
            return out
        count, first = count[doc], w.offsets[:-1][doc]
        step0 = min(self.classes) // 2
        layouts = {}
        blocks = -(-count // step0)
        base = np.concatenate([[0], np.cumsum(blocks)])
        # minima of stretches of step0 shingles; gaps between texts fall to a stretch of their own that is skipped
        begin = np.repeat(first - base[:-1] * step0, blocks) + np.arange(base[-1]) * step0
        finish = np.minimum(begin + step0, np.repeat(first + count, blocks))
        cut = np.empty(2 * len(begin), np.int64)
        cut[::2], cut[1::2] = begin, np.minimum(finish, len(g) - 1)
        step, b = step0, blocks
        for size in sorted(self.classes):
            while step < size // 2:
                step, b = step * 2, -(-b // 2)
            layouts[size] = (step // step0, b)
        for k in range(MINIMA):
            x = _hashed(g, k)
            low = np.minimum.reduceat(x, cut)[::2]
            if finish[-1] == len(g):
                low[-1] = x[begin[-1] :].min()
            at, factor, b = low, 1, blocks
            for size, rows in sorted(self.classes.items()):
                while factor < layouts[size][0]:
                    half = -(-b // 2)
                    start = np.repeat(np.concatenate([[0], np.cumsum(b)[:-1]]), half) + 2 * (np.arange(half.sum()) - np.repeat(np.concatenate([[0], np.cumsum(half)[:-1]]), half))
                    at, b, factor = np.minimum.reduceat(at, start), half, factor * 2
                edge = np.cumsum(b)
                window = at.copy()
                for ahead in (1, 2):
                    inside = np.arange(len(at) - ahead) + ahead < np.repeat(edge, b)[: len(at) - ahead] if len(at) > ahead else np.zeros(0, bool)
                    window[: len(inside)] = np.where(inside, np.minimum(window[: len(inside)], at[ahead:]), window[: len(inside)])
                minima, js, known = rows[k]
                maybe = np.flatnonzero(known[window >> np.uint32(16)])
                lo = np.searchsorted(minima, window[maybe], side="left")
                hi = np.searchsorted(minima, window[maybe], side="right")
                for p, x0, x1 in zip(maybe[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    d = int(doc[np.searchsorted(edge, p, side="right")])
                    out.update((d, int(j)) for j in js[x0:x1])
        return out

    def matches(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, of them in the text), verified."""
        w = words(texts, lower=True)
        out, own, last = [], None, -1
        for d, j in sorted(self.candidates(w)):
            s = self.sets[j]
            if self.n_words[j] < N:
                out.append((d, j, 1, 1))
                continue
            if d != last:
                own, last = np.unique(shingles(w.hash[w.of(d)], N)), d
            shared = int(np.isin(s, own, assume_unique=True).sum())
            if shared >= threshold * len(s) - 1e-9:
                out.append((d, j, len(s), shared))
        return out


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    n = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) / ITEM_BYTES))
    for k in range(n):
        yield Index(sorted(map(tuple, rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()), key=str))


def find(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and contained item; see RESULT."""
    spark, out = documents.sparkSession, None
    schema = pa.schema([(x.split()[0], pa.float64() if x.endswith("double") else pa.int64()) for x in RESULT.split(", ")])
    for index in _blocks(benchmark):
        held = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ix = held.value
            for b in sliced(batches):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[d], ix.ids[j], n, m, m / n) for d, j, n, m in ix.matches(b.column("text"), threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], schema.types[c]) for c in range(5)], schema=schema)

        part = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that contain no item."""
    spark, out = documents.sparkSession, documents
    for index in _blocks(benchmark):
        held = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, *_ in held.value.matches(b.column("text"), threshold)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(scan, out.schema)
    return out

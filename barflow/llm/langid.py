"""Language identification by nearest centroid over TF-IDF character n-grams.

A text becomes the counts of its letter runs' byte 1- to 4-grams, hashed into
DIMS cells, damped, weighted by inverse document frequency and normalised.
Each language has several centroids, found by spherical k-means over its
training texts; the nearest by cosine names the language and its distance
decides rejection.

Training texts are a hash sample of at most PER_LANGUAGE labelled documents a
language (documented bound); every text is scored whole.  Defined results: a
null text or one without letters is `und` with score 0; ties go to the
language first in order; an empty training table makes every row `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import buffer, sliced

DIMS = 8192
PER_LANGUAGE = 600
#: Training texts of all languages together, at most about so many (16 KB each on the driver); many languages share them.
TOGETHER = 24_000
CENTROIDS = 4
#: Cosine distance from the nearest centroid beyond which a text counts as none of the languages.
REJECT_DISTANCE = 0.85
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[:0x41] = 0x20
_FOLD[0x5B:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20


def histograms(texts: pa.Array) -> np.ndarray:
    """Damped n-gram counts, a row of DIMS cells for each text."""
    data, off = buffer(texts)
    b = _FOLD[data]
    high = np.concatenate([np.zeros(1, bool), data[:-1] == 0xC3]) & (data >= 0x80) & (data < 0x9F) & (data != 0x97)
    b = np.where(high, b + np.uint8(0x20), b)  # upper-case Latin-1 letters
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)  # one space between runs of letters
    first = off[:-1][off[:-1] < len(b)]
    keep[first] = True
    doc = np.searchsorted(off, np.flatnonzero(keep), side="right") - 1
    b = b[keep].astype(np.uint32)
    out = np.zeros((len(off) - 1) * DIMS, np.float32)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] if n > 1 else b + np.uint32(1)
        cell = ((code * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(19)
        same = doc[: len(cell)] == doc[n - 1 : n - 1 + len(cell)]
        if n == 1:
            same = same & (b != 0x20)
        out += np.bincount(doc[: len(cell)][same] * DIMS + cell[same], minlength=len(out)).astype(np.float32)
    out = out.reshape(-1, DIMS)
    return np.log1p(out)


def normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; starts are spread by farthest-point choice, so the result is deterministic."""
    c = [normal(x.mean(axis=0, keepdims=True))[0]]
    near = x @ c[0]
    while len(c) < min(k, len(x)):
        c.append(x[int(near.argmin())])
        near = np.maximum(near, x @ c[-1])
    centres = np.array(c)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = normal(x[own == j].mean(axis=0, keepdims=True))[0]
    return centres


class Model:
    def __init__(self, rows: list[tuple[str, bytes]]):
        """rows: language and float16 histogram of each training text."""
        rows = sorted(rows)
        self.languages = sorted({lang for lang, _ in rows})
        x = np.array([np.frombuffer(h, np.float16) for _, h in rows], np.float32).reshape(-1, DIMS)
        seen = (x > 0).sum(axis=0)
        self.idf = (np.log((1 + len(rows)) / (1 + seen)) + 0.1).astype(np.float32)
        x = normal(x * self.idf)
        y = np.array([lang for lang, _ in rows])
        centres = [spherical_kmeans(x[y == lang], CENTROIDS) for lang in self.languages]
        self.owner = np.repeat(np.arange(len(centres)), [len(c) for c in centres])
        self.centres = (np.concatenate(centres) if centres else np.zeros((0, DIMS))).astype(np.float32)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: none), its share of similarity from 0 to 1, and the distance from its nearest centroid."""
        n = len(texts)
        letters = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        if not self.languages or n == 0:
            return np.full(n, -1), np.zeros(n), np.ones(n)
        near = normal(histograms(texts) * self.idf) @ self.centres.T
        best = np.stack([near[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        pred = best.argmax(axis=1)
        e = np.exp((best - best.max(axis=1, keepdims=True)) * 20.0)
        return np.where(letters, pred, -1), np.where(letters, e.max(axis=1) / e.sum(axis=1), 0.0), np.where(letters, 1.0 - best.max(axis=1), 1.0)


def fit(documents: DataFrame, training: Column, label: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on a bounded hash sample of the rows that `training` admits; only their histograms reach the driver."""
    known = documents.filter(training & F.col(label).isNotNull() & F.col("text").isNotNull())
    counts, share = known.groupBy(label).count().collect(), F.lit(0.0)  # a row a language
    each = min(per_language, TOGETHER // max(len(counts), 1))
    for r in counts:
        share = F.when(F.col(label) == r[label], F.lit(min(1.0, each / r["count"]))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select(F.col(label).alias("lang"), "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, limit=1 << 20):
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                h = histograms(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([x.tobytes() for x in h], pa.binary())], names=["lang", "h"])

    return Model([(r["lang"], bytes(r["h"])) for r in chosen.mapInArrow(grams, "lang string, h binary").collect()])


def identify(documents: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred, score, distance and rejected (farther than REJECT_DISTANCE from every centroid)."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b in sliced(batches, limit=1 << 20):
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                pred, share, distance = m.predict(part.column("text"))
                own = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(names[pred].tolist(), pa.string()), pa.array(share, pa.float64()), pa.array(distance, pa.float64()), pa.array((distance > REJECT_DISTANCE).tolist(), pa.bool_())], names=[*keep, "lang_pred", "score", "distance", "rejected"])

    rows = documents.select(*keep, "text")
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(score, f"{types}, lang_pred string, score double, distance double, rejected boolean")

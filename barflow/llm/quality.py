"""Document quality by regularised quadratic discriminant analysis.

Each class has a mean and a covariance of transformed document statistics;
covariances shrink towards the pooled one and a scaled identity, their
Cholesky factors are computed once, and a text's score is the logistic of the
difference of the two log densities (half squared Mahalanobis distances and
log determinants), divided by TEMPER, plus the log odds of the classes.  The
tempering is there because the statistics of a text depend on one another more
than a normal density allows, so untempered scores are nearly all 0 or 1; it
keeps the order of documents and, at even classes, the side of 0.5.

Fitted on at most SAMPLE labelled documents (documented bound); every text is
scored whole.  Defined results: a null text counts as empty; without labels
of both classes every score is the share of the class that is there (0.5 if
none); repeated rows are scored each, and label rows of one document that
contradict one another count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import labelled_sample
from .text import _SPACE, sliced, words

SAMPLE = 12_000
#: Shares of the pooled covariance and of the scaled identity in each class covariance.
POOL, RIDGE = 0.15, 0.02
FEATURES = 16
TEMPER = 4.0


def statistics(texts: pa.Array) -> np.ndarray:
    """FEATURES transformed statistics of each text, computed for the whole batch at once."""
    w = words(texts)
    data, n = w.data, len(w)
    off = w.offsets
    doc_of_word = np.repeat(np.arange(n), np.diff(off))
    bytes_off = _byte_offsets(texts)
    doc_of_byte = np.repeat(np.arange(n), np.diff(bytes_off))
    count = lambda mask: np.bincount(doc_of_byte[mask], minlength=n).astype(float)
    upper = count((data >= 0x41) & (data <= 0x5A))
    lower = count((data >= 0x61) & (data <= 0x7A))
    high = count(data >= 0x80)
    digit = count((data >= 0x30) & (data <= 0x39))
    lines = count(data == 0x0A) + 1
    mild = count(np.isin(data, np.frombuffer(b".,;:'\"-", np.uint8)))
    odd = count((data > 0x20) & (data < 0x7F)) - upper - lower - digit - mild
    chars = np.maximum(upper + lower + high + digit + mild + odd, 1)
    k = np.diff(off).astype(float)
    one = np.maximum(k, 1)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(doc_of_word, length, n) / one
    spread = np.sqrt(np.maximum(np.bincount(doc_of_word, length**2, n) / one - mean**2, 0))
    order = np.lexsort((w.hash, doc_of_word))
    h, d = w.hash[order], doc_of_word[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[fresh], minlength=n)
    runs = np.diff(np.concatenate([np.flatnonzero(fresh), [len(h)]]))
    most = np.zeros(n)
    np.maximum.at(most, d[fresh], runs)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
    repeated = np.bincount(doc_of_word[again], minlength=n)
    first, last = data[w.start] if len(w.start) else data[:0], data[w.end - 1] if len(w.end) else data[:0]
    letter = lambda x: ((x >= 0x41) & (x <= 0x5A)) | ((x >= 0x61) & (x <= 0x7A)) | (x >= 0x80)
    plain = np.bincount(doc_of_word[letter(first)], minlength=n)
    stops = np.bincount(doc_of_word[np.isin(last, np.frombuffer(b".!?", np.uint8))], minlength=n)
    rate = lambda x, y: np.log(x / y + 0.005)
    return np.stack(
        [
            np.log1p(k), np.log1p(mean), np.log1p(spread), rate(upper, chars), rate(high, chars), rate(digit, chars), rate(mild, chars), rate(odd, chars),
            rate(lines, one), distinct / np.sqrt(one) / (1 + np.log1p(k)), distinct / one, rate(most, one), rate(repeated, one), plain / one, rate(stops, one), np.log1p(one / lines),
        ],
        axis=1,
    )


def _byte_offsets(texts: pa.Array) -> np.ndarray:
    from .text import buffer

    return buffer(texts)[1]


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.flat = not 0 < self.prior < 1 or min(y.sum(), len(y) - y.sum()) < 2
        if self.flat:
            return
        self.shift, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = (x - self.shift) / self.scale
        pooled = sum(np.cov(z[y == c].T) * (y == c).sum() for c in (0, 1)) / len(y)
        self.means, self.factors, self.logdet = [], [], []
        for c in (0, 1):
            own = np.cov(z[y == c].T)
            s = (1 - POOL) * own + POOL * pooled
            s = (1 - RIDGE) * s + RIDGE * max(np.trace(s) / len(s), 0.05) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.means.append(z[y == c].mean(axis=0))
            self.factors.append(np.linalg.inv(factor))
            self.logdet.append(2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        z = np.clip((x - self.shift) / self.scale, -30, 30)
        density = [-0.5 * ((((z - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.logdet, strict=True)]
        odds = np.clip((density[1] - density[0]) / TEMPER + np.log(self.prior / (1 - self.prior)), -40, 40)
        return 1 / (1 + np.exp(-odds))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.int32()), pa.array([x.tobytes() for x in statistics(b.column("text"))], pa.binary())], names=["y", "x"])


def fit(documents: DataFrame, labels: DataFrame, training: Column, column: str = "quality", bound: int = SAMPLE) -> Model:
    rows = labelled_sample(documents, labels, column, training, bound).mapInArrow(_numbers, "y int, x binary").collect()
    rows = sorted((bytes(r["x"]), r["y"]) for r in rows)
    x = np.array([np.frombuffer(r[0], np.float64) for r in rows]).reshape(-1, FEATURES)
    return Model(x, np.array([r[1] for r in rows], float))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.score(statistics(b.column("text"))), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")

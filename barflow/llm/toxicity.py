"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of two lexicons (a fixed list of English insults and one
learned from the training labels: words and word beginnings frequent in toxic
texts and rare in others), how near lexicon words stand to second-person
words, capitals, punctuation and obfuscation (words that spell a lexicon word
only after look-alike characters are replaced).

The learned lexicon, the trees and the calibration use three disjoint hash
folds of a bounded sample (SAMPLE rows, documented bound), so none is fitted
to what another has memorised; every text is scored whole.  Defined results:
a null text counts as empty; without labels of both classes every score is
the share of the class that is there (0 if none); repeated rows are scored
each, and label rows of one document that contradict one another count each;
other columns are ignored.  The lexicon has every entry that meets MIN_TEXTS and
MIN_RATIO; it is bounded by the sample, which is the one bound of training.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled_sample
from .text import sliced

SAMPLE = 9_000
THRESHOLD = 0.3
#: A learned entry stands in that many toxic training texts at least, and so many times as often in them as in others.
MIN_TEXTS, MIN_RATIO = 4, 12.0

# Common English insults, second-person words of four languages, look-alike characters.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb scum trash garbage loser losers worthless pathetic disgusting clown fool filth vermin "
    "imbecile cretin dimwit jerk bastard bitch crap damn hate kill shut ugly useless retard retarded whore slut bullshit asshole".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre du dich dir dein deine ihr euch usted ti tuyo".split())
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})

_WORD = re.compile(r"[^\W\d_]+")
_DISGUISED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]++[0134579@$!*._-]+)+[^\W\d_]+")
_CAPITAL = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de\u0386-\u03ab\u0400-\u042f]")
FEATURES = 14
#: Words whose weight a task remembers at most.
KNOWN = 1 << 18


def beginnings(word: str) -> list[str]:
    """The word and its beginnings of 4 to 7 letters, marked."""
    return [word, *(word[:k] + "~" for k in range(4, min(len(word), 8)))]


def features(text: str | None, learned: dict[str, float], known: dict[str, float] | None = None) -> list[float]:
    """The numbers of one text; known: weights of words met before, which fills up to KNOWN of them."""
    text, known = text or "", {} if known is None else known
    low = text.lower()
    counts = Counter(_WORD.findall(low))
    n = sum(counts.values())
    insults = sum(counts[w] for w in INSULTS & counts.keys())
    hits, weight, top, kinds, hot = 0, 0.0, 0.0, 0, set()
    for w, c in counts.items():
        v = known.get(w)
        if v is None:
            v = max(learned.get(x, 0.0) for x in beginnings(w))
            if len(known) < KNOWN:
                known[w] = v
        if v:
            hits, weight, top, kinds = hits + c, weight + c * v, max(top, v), kinds + 1
        if v or w in INSULTS:
            hot.add(w)
    near = 0.0
    if hot:
        w = low.split()
        at = [k for k, x in enumerate(w) if any(p in hot for p in _WORD.findall(x))]
        you = np.array([k for k, x in enumerate(w) if x.strip(".,!?;:") in SECOND_PERSON])
        if len(you):
            at, after = np.array(at), np.searchsorted(you, at)
            far = np.minimum(np.abs(you[np.minimum(after, len(you) - 1)] - at), np.abs(at - you[np.maximum(after - 1, 0)]))
            near = float((1.0 / (1.0 + far)).sum())
    hidden = sum(1 for x in _DISGUISED.findall(low) if (y := x.translate(LOOK_ALIKE)) in INSULTS or y in learned)
    letters = sum(len(w) * c for w, c in counts.items())
    capital = len(_CAPITAL.findall(text))
    marks = sum(map(text.count, "!?"))
    odd = sum(map(text.count, "*$%&#@"))
    size = max(len(text), 1)
    return [
        insults / max(n, 1) * 100, np.log1p(insults), hits / max(n, 1) * 100, np.log1p(hits), weight / max(n, 1) * 100, top, np.log1p(kinds), near,
        hidden / max(n, 1) * 100, capital / max(letters, 1), marks / size * 100, odd / size * 100, np.log1p(n), len(counts) / max(n, 1),
    ]


class Trees:
    """Boosted regression trees on binned features with logistic loss; nodes are kept in arrays, level by level."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, leaf: float = 4.0, bins: int = 32):
        self.depth, self.rate = depth, rate
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            node = np.zeros(len(y), int)
            feature, split = np.zeros(2**depth - 1, int), np.full(2**depth - 1, bins + 1)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                gain = np.full(width, 1e-9)
                for k in range(x.shape[1]):
                    cell = node * (bins + 1) + b[:, k]
                    gs = np.bincount(cell, g, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                    hs = np.bincount(cell, h, width * (bins + 1)).reshape(width, -1).cumsum(axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gains = gs**2 / (hs + leaf) + (ga - gs) ** 2 / (ha - hs + leaf) - ga**2 / (ha + leaf)
                    j = gains.argmax(axis=1)
                    top = gains[np.arange(width), j]
                    won = top > gain
                    gain = np.where(won, top, gain)
                    feature[first : first + width] = np.where(won, k, feature[first : first + width])
                    split[first : first + width] = np.where(won, j, split[first : first + width])
                own = first + node
                node = node * 2 + (b[np.arange(len(y)), feature[own]] > split[own])
            value = np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + leaf)
            f = f + rate * value[node]
            self.trees.append((feature, split, value))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, split, value in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                own = 2**level - 1 + node
                node = node * 2 + (b[rows, feature[own]] > split[own])
            f += self.rate * value[node]
        return f


def isotonic(s: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: ascending scores and the non-decreasing weighted rates at them."""
    order = np.argsort(s, kind="stable")
    at, first = np.unique(s[order], return_index=True)
    weight = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0)
    total = np.add.reduceat((y * weights)[order], first) if len(first) else np.zeros(0)
    blocks: list[list[float]] = []
    for t, w in zip(total, weight, strict=True):
        blocks.append([t, w, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t2, w2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + w2, blocks[-1][2] + n2]
    rate = np.concatenate([np.full(n, t / w) for t, w, n in blocks]) if blocks else np.zeros(0)
    return at, rate


class Model:
    def __init__(self, learned: dict[str, float], trees: Trees | None, steps: tuple[np.ndarray, np.ndarray] | None, prior: float):
        self.learned, self.trees, self.steps, self.prior = learned, trees, steps, prior
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        raw = self.trees.raw(np.array([features(t, self.learned, self.known) for t in texts], float).reshape(-1, FEATURES))
        return np.clip(np.interp(raw, *self.steps), 0, 1)


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            seen[int(y == 1)].update({p for w in set(_WORD.findall((text or "").lower())) for p in beginnings(w)})
        rows = [(p, seen[1][p], seen[0][p]) for p in seen[0].keys() | seen[1].keys()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["entry", "toxic", "clean"])


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries whose share of toxic texts is MIN_RATIO times that of the others, with the log of that ratio."""
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return {}
    ratio = (F.sum("toxic") / pos) / ((F.sum("clean") + 1) / (neg + 1))
    best = sample.mapInArrow(_beginnings, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("n"), ratio.alias("ratio")).filter((F.col("n") >= MIN_TEXTS) & (F.col("ratio") >= MIN_RATIO))
    return {r["entry"]: float(np.log(r["ratio"])) for r in best.collect()}


def fit(documents: DataFrame, labels: DataFrame, training: Column, column: str = "toxic", bound: int = SAMPLE) -> Model:
    sample = cut(labelled_sample(documents, labels, column, training, bound))
    part = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(10))  # copies of a text share a fold
    learned = learn_lexicon(sample.filter(part < 5))
    real = {r["y"]: r["count"] for r in labels.filter(training & F.col(column).isNotNull()).groupBy(F.col(column).cast("int").alias("y")).count().collect()}
    prior = real.get(1, 0) / max(sum(real.values()), 1)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in sliced(batches):
            x = [np.array(features(t, learned, known)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), b.column("y"), b.column("part").cast(pa.int32())], names=["x", "y", "part"])

    rows = sorted((bytes(r["x"]), r["y"], r["part"]) for r in sample.filter(part >= 5).select("text", "y", part.cast("int").alias("part")).mapInArrow(numbers, "x binary, y int, part int").collect())
    x = np.array([np.frombuffer(r[0]) for r in rows]).reshape(-1, FEATURES)
    y, part_of = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    tree_rows = part_of < 8
    if not 0 < y[tree_rows].sum() < tree_rows.sum() or not (~tree_rows).any():
        return Model(learned, None, None, prior)
    trees = Trees(x[tree_rows], y[tree_rows])
    # the sample is balanced by class, so in the calibration each row stands for as many as the labels have
    raw, truth = trees.raw(x[~tree_rows]), y[~tree_rows]
    share = y.mean()
    return Model(learned, trees, isotonic(raw, truth, np.where(truth == 1, prior / share, (1 - prior) / (1 - share))), prior)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.score(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(scored, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")

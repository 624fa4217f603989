"""The search over posting lists against full scores, its bounds and the products that it makes."""

import numpy as np
from pyspark.sql import functions as F

from barflow.llm import topk


def full(ids, m, q, own, k):
    scores = m @ q
    return sorted((-int(scores[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != own)[:k]


def best(block, q, own, k):
    at, scores, spent = topk.search(block, q, own, k)
    return sorted(zip((-scores).tolist(), block.ids[at].tolist()))[:k], spent


def test_copies_of_the_query_do_not_hide_answers():
    rng = np.random.default_rng(3)
    for copies in (1, 2, 6, 9):
        for _ in range(20):
            k, dims = 4, 128
            m = np.round(rng.normal(size=(300, dims)) * np.linspace(60, 0.5, dims) ** 1.5 / 10).astype(np.int64)
            ids = np.arange(300)
            m[:copies], ids[:copies] = m[0] * 4, 1000
            q = m[0] // 4
            assert best(topk.Block(ids, m), q, 1000, k)[0] == full(ids, m, q, 1000, k)


def test_products_follow_the_postings():
    """Where impacts are skewed most postings are never read; empty components have none; dense even ones save little but cost no more than a plain product."""
    rng = np.random.default_rng(8)
    n, dims, k = 4000, 64, 10
    skewed = np.round(rng.normal(size=(n, dims)) * np.exp(rng.normal(size=(n, 1))) * 400 * 0.9 ** np.arange(dims)).astype(np.int64)
    sparse = np.where(rng.random((n, dims)) < 0.05, rng.integers(-40, 40, (n, dims)), 0)
    dense = rng.integers(-40, 40, (n, dims))
    shares = {}
    for name, m in (("skewed", skewed), ("sparse", sparse), ("dense", dense)):
        block, made = topk.Block(np.arange(n), m), []
        for own in range(0, n, 200):
            got, spent = best(block, m[own], own, k)
            assert got == full(np.arange(n), m, m[own], own, k)
            made.append(spent / m.size)
        shares[name] = float(np.mean(made))
    assert shares["skewed"] < 0.5 and shares["sparse"] < 0.1 and shares["dense"] <= 1, shares


def test_postings_are_ordered_by_impact():
    rng = np.random.default_rng(1)
    m = np.where(rng.random((500, 7)) < 0.6, rng.integers(-3000, 3000, (500, 7)), 0)
    block = topk.Block(np.arange(500), m)
    assert block.ends[-1, -1] == np.count_nonzero(m)
    for d in range(7):
        own = slice(block.ends[d, 0], block.ends[d, -1])
        assert (m[block.rows[own], d] == block.values[own]).all()
        bits = np.maximum(topk._bits(block.values[own]), block.levels.min())
        assert (np.diff(bits) <= 0).all()


def test_empty_and_large_components():
    assert topk.search(topk.Block(np.zeros(0, np.int64), np.zeros((0, 0), np.int64)), np.array([1, 2]), 0, 3)[0].size == 0
    m = np.array([[2**40, -1], [2**39, 5], [0, 0], [3, 2**40]])
    assert best(topk.Block(np.arange(4), m), m[0], 0, 2)[0] == full(np.arange(4), m, m[0], 0, 2)


def test_one_id_and_equal_rows(spark):
    """A third of the rows are one row, of another third one id; groups of a few rows."""
    rng = np.random.default_rng(4)
    rows = [(7, [0.5, 0.25])] * 40 + [(9, [float(a), float(b)]) for a, b in rng.normal(size=(40, 2))] + [(100 + i, [float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    ids, m = np.array([r[0] for r in rows]), np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64)
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 20 == 7, k=5).collect())
    want = sorted((7, rank, vec, -score) for _ in range(40) for rank, (score, vec) in enumerate(full(ids, m, m[0], 7, 5), 1))
    assert len(got) == 5 * sum(i % 20 == 7 for i in ids) and [g for g in got if g[0] == 7] == want

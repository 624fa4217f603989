"""Exact top-k inner-product search over an impact-ordered score-at-a-time index.

Components are quantised to integers.  An index block keeps a posting list for
each dimension: the rows with a non-zero component there and its value, ordered
by descending quantised impact, the number of bits of the value.  The postings
of one dimension and one impact are a segment.  For a query, the impact of a
segment is that number plus the number of bits of the query's own component, so
a unit more doubles what a posting can add.  Segments of all lists are taken by
descending impact and added to the accumulators of their rows; a posting that
is not reached costs nothing.  The search stops only on proof: what the
segments of lower impact can still add to a row is bounded, level by level, by
Cauchy-Schwarz; rows whose upper bound is below the k-th lower bound are out,
and as soon as scoring the possible members exactly takes fewer products than
the postings left, they are scored exactly.

Queries and index are cut by hash into groups of bounded size; each pair of
groups is one task, and only k rows a query and group are shuffled on.  The
index passes the shuffle once per QUERY_ROWS queries (a small one a few times
more, so that every core has queries), the queries once per group of the index.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as padded with zeros; equal scores go to
the smaller id; rows sharing an id are separate candidates but never answers
to a query of that id; empty tables give no rows.  Equal rows are searched
once: of those in the index k are kept, as no query can name more, and queries
are repeated in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
#: Rows of an index block, whose accumulators are one array; of a group of blocks, the index side of a task, at most; of its queries.
INDEX_BLOCK, INDEX_ROWS, QUERY_ROWS = 32_768, 131_072, 131_072
#: Impact levels of an index at most, the lowest joined.
LEVELS = 8
RESULT = "query_row long, query_id long, vec_id long, score long, copies long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id and integer components of the vectors that take part, equal rows once with their number."""
    x = F.col(vec_col)
    fit = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).cast("array<long>").alias("q"))
    return rows.groupBy("id", "q").agg(F.count(F.lit(1)).alias("copies"))


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """A group as one row: ids, numbers of copies, and components in the narrowest whole-number type."""
    q = rows.column("q").combine_chunks()
    sizes = np.diff(q.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    m = np.zeros((len(sizes), dims), np.int64)
    m[np.arange(dims)[None, :] < sizes[:, None]] = q.flatten().to_numpy()
    narrow = next(t for t in (np.int16, np.int32, np.int64) if m.min(initial=0) >= np.iinfo(t).min and m.max(initial=0) <= np.iinfo(t).max)
    whole = lambda name: pa.array([rows.column(name).to_numpy().astype(np.int64).tobytes()], pa.binary())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "dims": pa.array([dims], pa.int64()), "kind": pa.array([np.dtype(narrow).str]), "ids": whole("id"), "copies": whole("copies"), "m": pa.array([m.astype(narrow).tobytes()], pa.binary())})


PACKED = "block long, dims long, kind string, ids binary, copies binary, m binary"


def _unpacked(rows: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for x in rows.to_pylist():
        ids = np.frombuffer(x["ids"], np.int64)
        yield x["block"], ids, np.frombuffer(x["copies"], np.int64), np.frombuffer(x["m"], x["kind"]).reshape(len(ids), x["dims"])


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of bits of the absolute value: the quantised impact of a component."""
    return np.frexp(np.abs(x.astype(np.float64)))[1]


class Block:
    """Posting lists of an index block, and the norm of each row's components of an impact level."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m
        n, dims = m.shape
        bits = _bits(m)
        self.levels = np.unique(bits[bits > 0])[-LEVELS:][::-1]
        row, dim = np.nonzero(m)
        level = np.searchsorted(-self.levels, -np.maximum(bits[row, dim], self.levels.min(initial=99)))
        place = dim * max(len(self.levels), 1) + level
        order = np.argsort(place, kind="stable")
        self.rows = row[order]
        self.values = m[row, dim][order].astype(np.float64)
        #: ends[d, l]: where the postings of dimension d with the l highest impacts end
        self.ends = np.searchsorted(place[order], np.arange(dims)[:, None] * max(len(self.levels), 1) + np.arange(len(self.levels) + 1)[None, :])
        self.most = float(np.abs(self.values).max(initial=0))
        squares = [np.bincount(row[level == k], m[row, dim][level == k].astype(np.float64) ** 2, n) for k in range(len(self.levels))]
        self.norms = np.sqrt(np.array(squares)).reshape(len(self.levels), n)


def search(block: Block, q: np.ndarray, own: int, k: int, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of all rows of the block that can be among the query's k best with a score of at least `floor`, and the products made.

    The first step takes the segments of all impacts too high to prove anything
    before them, each later step those of one impact less.
    """
    dims = min(len(q), block.m.shape[1])
    q, n, spent = q[:dims].astype(np.int64), len(block.ids), 0
    others = block.ids != own  # rows of the query's own id are no answers, so they bound nothing
    live = np.flatnonzero(others)
    used = np.flatnonzero(q)
    largest = float(np.abs(q).max(initial=0)) * block.most * max(dims, 1)
    if 0 < largest < 2**53 and len(live) > k:  # so that accumulators hold whole numbers exactly
        bits, squares, factors = _bits(q[used]), q[used].astype(np.float64) ** 2, q[used].astype(np.float64)
        impacts = np.unique(bits[:, None] + block.levels[None, :])[::-1]
        rest = [np.where(bits[:, None] + block.levels[None, :] < e, squares[:, None], 0).sum(axis=0) for e in impacts]
        start = next((s for s, r in enumerate(rest) if r.min() <= 0.1 * squares.sum()), len(rest) - 1)
        acc, at = np.zeros(n), block.ends[used, 0].copy()
        left = int((block.ends[used, -1] - at).sum())
        for e, r in zip(impacts[start:], rest[start:], strict=True):
            upto = block.ends[used, (bits[:, None] + block.levels[None, :] >= e).sum(axis=1)]
            parts = [(slice(at[d], upto[d]), factors[d]) for d in np.flatnonzero(upto > at)]
            if parts:
                acc += np.bincount(np.concatenate([block.rows[p] for p, _ in parts]), np.concatenate([block.values[p] * f for p, f in parts]), n)
            taken = int((upto - at).sum())
            spent, left, at = spent + taken, left - taken, upto
            slack = (np.sqrt(r) @ block.norms) * (1 + 1e-6) + 1e-3 if left else np.zeros(n)
            least = (acc - slack)[live] if len(live) < n else acc - slack
            floor = max(floor, float(np.partition(least, len(least) - k)[len(least) - k])) if len(least) > k else floor
            live = live[(acc + slack)[live] >= floor]
            if not left:
                return live, acc[live].astype(np.int64), spent
            if len(live) * dims <= left:
                break
    exact = np.float64 if largest < 2**53 else np.int64
    return live, (block.m[live, :dims].astype(exact) @ q.astype(exact)).astype(np.int64), spent + len(live) * dims


def _search_pairs(k: int):  # noqa: ANN202
    def pair(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        blocks = [Block(ids[s : s + INDEX_BLOCK], m[s : s + INDEX_BLOCK]) for _, ids, _, m in _unpacked(index) for s in range(0, len(ids), INDEX_BLOCK)]
        for number, ids, copies, m in _unpacked(queries):
            for j, (own, q) in enumerate(zip(ids, m, strict=True)):
                vec, score, floor = np.zeros(0, np.int64), np.zeros(0, np.int64), -math.inf
                for b in blocks:
                    at, s, _ = search(b, q, own, k, floor)
                    vec, score = np.concatenate([vec, b.ids[at]]), np.concatenate([score, s])
                    top = np.lexsort((vec, -score))[:k]
                    vec, score = vec[top], score[top]
                    floor = float(score[-1]) if len(top) == k else floor
                out.append([np.full(len(vec), (number << 32) + j), np.full(len(vec), own), vec, score, np.full(len(vec), copies[j])])
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in RESULT.split(", ")])

    return pair


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each query, ties to the smaller id."""
    index = quantised(vectors, id_col, vec_col, scale).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    queries = quantised(vectors.filter(is_query), id_col, vec_col, scale).withColumn("copy", F.lit(1))
    n, nq = index.count(), queries.count()
    groups, blocks = max(1, math.ceil(n / INDEX_ROWS)), max(1, math.ceil(nq / QUERY_ROWS))
    # small sets of queries are cut finer, so that every core has a pair to search; the result is the same
    blocks = max(blocks, min(math.ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / groups), math.ceil(nq / 64)))
    hashed = lambda df, parts: df.withColumn("part", F.pmod(F.xxhash64("id", "q", "copy"), F.lit(parts)).cast("long")).groupBy("part").applyInArrow(_pack, PACKED)
    i = hashed(index, groups).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("pair", F.col("block") * blocks + F.col("other"))
    q = hashed(queries, blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("pair", F.col("other") * blocks + F.col("block"))
    tasks = min(groups * blocks, 32_768)
    i, q = i.repartition(tasks, "pair"), q.repartition(tasks, "pair")
    found = i.groupBy("pair").cogroup(q.groupBy("pair")).applyInArrow(_search_pairs(k), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id")))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

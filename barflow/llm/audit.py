"""Interaction of corpus filters: what each of them removes in every order, from counts of failure masks.

Each document is a mask of the filters it fails.  The counts of masks of a part
are all that the audit needs: the subset-zeta transform turns them into the
survivors of every subset of filters, and a step of an order is the difference
of two neighbouring subsets.  Documents with labels have counts of their own
and go through the same transform.

Texts are read once and never shuffled: a row goes on with its id, part, mask
and the 256-bit digest of its text.  Equal rows are counted before they are
shuffled, and the first row of each text comes from an aggregate and a join on
digest and id, so that a text which a third of all rows share makes no hot key.

Defined results: a null text is empty; a null source is the part ''; a row
without doc_id never counts as a repeat, nor as the first of its text;
repeated rows of one doc_id all count, and are repeats of a smaller doc_id
only; a document has a label if any of its label rows says 1; an empty table
has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
REPEAT = FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts whose rows (600 each) one batch holds.
PARTS = 64


def failures(text: Column, words: Column) -> Column:
    """Mask of the filters A to D that a text fails: few words, few distinct words, many capitals, symbols."""
    n, chars = F.size(words), F.length(text)
    capitals = chars - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * chars, text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and how many documents, good ones and toxic ones have it: at most 32 rows a part."""
    rows = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text"), F.col("words")).alias("mask"))
    rows = cut(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.when(F.col(x) == 1, 1).otherwise(0)).alias(y) for x, y in (("quality", "good"), ("toxic", "toxic"))])
    # rows without doc_id match nothing, and are dealt out by their digest
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(4096))).otherwise(0)
    rows = rows.withColumn("spread", spread).join(said.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").join(first, ["digest", "doc_id"], "left")
    mask = F.col("mask") + F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << REPEAT).otherwise(0)
    weighted = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), weighted("good"), weighted("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """Of counts by mask (last axis): those that pass all filters of each subset."""
    z = counts.copy()
    k = z.shape[-1].bit_length() - 1
    for f in range(k):
        pairs = z.reshape(*z.shape[:-1], 1 << (k - 1 - f), 2, 1 << f)
        pairs[..., 1, :] += pairs[..., 0, :]
    return z[..., ::-1]  # z sums over subsets of a mask; masks that miss S lie in its complement


def _steps() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    orders = ["".join(p) for p in permutations(FILTERS)]
    filters = np.array([[FILTERS.index(c) for c in o] for o in orders])
    after = np.bitwise_or.accumulate(1 << filters, axis=1)
    return orders, filters.ravel(), (after & ~(1 << filters)).ravel(), after.ravel()


def steps(parts: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """All steps of all orders of several parts; counts: parts x (documents, good, toxic) x masks."""
    orders, filters, before, after = _steps()
    left = survivors(counts)
    gone = left[..., before] - left[..., after]
    alone = 1 << np.arange(len(FILTERS))
    failing = left[:, 0, :1] - left[:, 0, alone]
    unique = left[:, 0, ALL ^ alone] - left[:, 0, ALL, None]
    shapley = np.stack([gone[:, 0, filters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    n, k = len(parts), len(filters)
    longs = [left[:, 0, after], gone[:, 0], failing[:, filters] - gone[:, 0], unique[:, filters], gone[:, 1], gone[:, 2], shapley[:, filters]]
    columns = [pa.array(np.repeat(np.array(parts, object), k), pa.string()), pa.array(np.tile(np.repeat(np.array(orders, object), len(FILTERS)), n), pa.string()), pa.array(np.tile(np.arange(k) % len(FILTERS) + 1, n), pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(x.ravel(), pa.int64()) for x in longs]], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        for at in range(0, len(rows), PARTS):
            some = rows[at : at + PARTS]
            counts = np.zeros((len(some), 3, ALL + 1), np.int64)
            for k, r in enumerate(some):
                for x in r["counts"]:
                    counts[k, :, x["mask"]] = x["n"], x["good"], x["toxic"]
            yield steps([r["part"] for r in some], counts)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see SCHEMA."""
    parts = masks(documents, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(_audit, SCHEMA)

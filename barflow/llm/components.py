"""Connected components by alternating large-star and small-star.

Links stay in DataFrames; each round is two aggregations and joins on node
ids, checkpointed in the shared folder.  A node's links are never gathered in
one task: minima are aggregated and joined back, so a hub is a skewed join
that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Links in a partition: a round over few links is not dealt from hundreds of nearly empty files.
LINKS = 200_000


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30))), F.sum("v")).first())


def connected_components(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """id, component: every node of a link with the smallest node that it reaches."""
    e = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    state = _sum(e)
    while state[0]:
        e = e.coalesce(max(1, -(-state[0] // LINKS)))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e = cut(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        state, before = _sum(e), state
        if state == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

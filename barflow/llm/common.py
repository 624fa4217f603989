"""Session helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut as cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Sides of joins up to this measured size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 128 << 20


def sized_broadcast(df: DataFrame, size: float) -> DataFrame:
    """Broadcast only a side whose measured size, in bytes, is under BROADCAST_BYTES; otherwise the join shuffles."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, where: Column, bound: int) -> DataFrame:
    """At most about `bound` labelled documents (doc_id, text, y), about half of each class.

    The ids are chosen by hash, so the sample does not depend on the
    partitioning; as the id list is bounded by the parameter it is
    broadcast and only chosen texts go on.
    """
    rows = labels.filter(where & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, bound / 2 / max(n, 1)))).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


#: Rows of one key that one task of a join may meet; a key with more is dealt over several tasks.
DEAL = 4096


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until the frame has no column of them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}".lower() in taken:
            name += "_"
        taken.add(f"_{name}".lower())
        out.append(f"_{name}")
    return out


def spread_join(rows: DataFrame, keyed: DataFrame, on: list[str], by: str, limit: int = DEAL, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with keyed (checkpointed, one row a key, its number of rows in n), hot keys dealt over tasks.

    Keys of more than `limit` rows, at most one in `limit` rows, get as many
    copies in `keyed` as it takes to leave each task about `limit` of theirs;
    a row of such a key goes to the copy that the hash of its column `by` names.
    """
    parts = F.ceil(F.col("n") / limit)
    hot = keyed.filter(F.col("n") > limit).select(*on, parts.alias("_parts"))
    count = hot.count()
    if not count:
        return rows.join(keyed, on, how)
    salted = rows.join(sized_broadcast(hot, (16 * len(on) + 32) * count), on, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1).cast("long")))).drop("_parts")
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")

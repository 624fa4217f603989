"""Bars kept as a table: a directory a day, bucketed by symbol.

Date ranges read their days only (partition pruning before any file is
opened), and windows and equi-joins by symbol find each symbol's rows in one
bucket, so they need no exchange (an as-of join stacks its sides, and does);
nothing is sorted across symbols.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; a symbol lies in one of them.
BUCKETS = 64


def store_bars(bars: DataFrame, table: str, buckets: int = BUCKETS, mode: str = "error") -> None:
    """Write bars (symbol, ts, ...) as a table of the session's catalog; mode append adds days or rows to it."""
    dealt = bars.withColumn("day", F.to_date("ts")).repartition(buckets, "symbol")
    dealt.write.mode(mode).format("parquet").partitionBy("day").bucketBy(buckets, "symbol").sortBy("symbol", "ts").saveAsTable(table)


def stored_bars(spark: SparkSession, table: str, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Bars of the table from start to end, both included; rows without a time are of no day and in no range."""
    rows = spark.table(table)
    for bound, after in ((start, True), (end, False)):
        if bound is not None:
            at = F.lit(bound).cast("timestamp_ntz")
            day, ts = F.col("day"), F.col("ts")
            rows = rows.filter((day >= at.cast("date")) & (ts >= at) if after else (day <= at.cast("date")) & (ts <= at))
    return rows.drop("day")

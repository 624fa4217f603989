"""A pyramid of bars kept up to date from ticks in any order.

The finest level is a log of partial bars, one committed folder a batch,
partitioned by day: a partial holds its bucket's first and last price with the
keys that order them, extremes, volume and count, so partials of one bucket
merge in any order.  Coarser levels are merged partials too, each made from the
one below; when rows come late, only the days they fall in are made again.  All
levels above the finest are functions of it, so an update that fails halfway is
simply run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeframe import floor_to, seconds
from .ledger import Ledger

DAY = 86_400
PARTIAL = ["first", "high", "low", "last", "volume", "n"]


def _merge(rows: DataFrame, bucket: Column) -> DataFrame:
    """Partials merged by symbol and bucket."""
    key = [F.to_date("_ts").alias("day"), "symbol", "_ts"]
    out = rows.withColumn("_ts", bucket).groupBy(*key).agg(F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("volume").alias("volume"), F.sum("n").alias("n"))
    return out.withColumnRenamed("_ts", "ts")


class Pyramid:
    """Levels of bars under one shared folder; each timeframe must divide the next, the last one a day."""

    def __init__(self, spark: SparkSession, folder: str, timeframes: Sequence[str] = ("1m", "5m", "15m", "1h", "4h", "1d")):
        widths = [seconds(t) for t in timeframes]
        if any(b % a for a, b in zip(widths, [*widths[1:], DAY], strict=True)):
            raise ValueError(f"each timeframe must divide the next, and the last a day: {list(timeframes)}")
        self.spark, self.folder, self.timeframes = spark, folder.rstrip("/"), list(timeframes)
        self.log = Ledger(spark, self.folder, "log")

    def _kept(self, timeframe: str) -> str:
        return f"{self.folder}/{timeframe}"

    def add(self, ticks: DataFrame, batch: int, price: str = "px", size: str = "value", order: str = "event_id") -> list[date]:
        """Take a batch of ticks (symbol, ts, price, size, order) once, and make the days it touches again; returns these."""
        at = lambda c: F.struct(F.col(order).alias("at"), F.col(c).alias("price"))
        ones = ticks.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), at(price).alias("first"), F.col(price).alias("high"), F.col(price).alias("low"), at(price).alias("last"), F.col(size).alias("volume"), F.lit(1).cast("long").alias("n"))
        self.log.write(batch, lambda path: _merge(ones, floor_to(F.col("ts"), self.timeframes[0])).hint("rebalance", "day").write.partitionBy("day").parquet(path))
        touched = self.spark.read.schema("symbol string, day date").parquet(f"{self.log.root}/batch={batch}")
        days = [r.day for r in touched.select("day").distinct().collect()]
        self.refresh(days)
        return sorted(days)

    def refresh(self, days: Sequence[date]) -> None:
        """Make all coarser levels of these days again, each from the one below."""
        if not days:
            return
        for below, timeframe in zip(self.timeframes, self.timeframes[1:], strict=False):
            made = _merge(self.partials(below).filter(F.col("day").isin(list(days))), floor_to(F.col("ts"), timeframe))
            # a day's rows come together in few files, and a hot day in several
            made.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self._kept(timeframe))

    def partials(self, timeframe: str) -> DataFrame:
        """Stored partials of a level; of the finest several a bucket, if it came in several batches."""
        path = self.log.root if timeframe == self.timeframes[0] else self._kept(timeframe)
        return self.spark.read.parquet(path).select("day", "symbol", "ts", *PARTIAL)

    def bars(self, timeframe: str, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
        """OHLCV of a level, from start to end, both included; only the days between are read."""
        rows = self.partials(timeframe)
        if start is not None:
            rows = rows.filter((F.col("day") >= F.lit(start).cast("timestamp_ntz").cast("date")) & (F.col("ts") >= F.lit(start).cast("timestamp_ntz")))
        if end is not None:
            rows = rows.filter((F.col("day") <= F.lit(end).cast("timestamp_ntz").cast("date")) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
        if timeframe == self.timeframes[0]:
            rows = _merge(rows, F.col("ts"))
        return rows.select("symbol", "ts", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "volume")

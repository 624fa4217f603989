"""Recorded candles of a venue as a table or a stream of bars.

Whatever fetches candles appends JSON lines below `path` in folders
symbol=…/timeframe=…, with the venue's own name of the timeframe; files are
written once.  Symbol and timeframe prune folders.  As a stream, each file is
an offset of Spark's file source: the checkpoint of the query says which were
read, so a restart loses and repeats none.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeframe import seconds
from ..schema import REQUIRED
from .bars import last_n, vendor_reader

#: Fields of a line, by venue.
LINES = {
    "crypto": "candle array<double>",
    "equity": "timestamp string, " + ", ".join(f"{c} double" for c in REQUIRED),
    "forex": "candle struct<time: string, complete: boolean, mid: struct<o: string, h: string, l: string, c: string>, volume: long>",
}


def venue_timeframe(venue: str, timeframe: str) -> str:
    """The venue's name of a timeframe of minutes, hours or days: 15m is 15Min, M15 or 15m."""
    vendor_reader(venue)
    n, unit = timeframe[:-1], timeframe[-1:]
    if not n.isdecimal() or unit not in "mhd" or not unit or (venue == "forex" and unit == "d" and n != "1"):
        raise ValueError(f"unsupported timeframe: {timeframe}")
    if venue == "equity":
        return n + {"m": "Min", "h": "Hour", "d": "Day"}[unit]
    return "D" if venue == "forex" and unit == "d" else unit.upper() + n if venue == "forex" else timeframe


def _bars(lines: DataFrame, venue: str, symbols: Sequence[str], timeframe: str) -> DataFrame:
    own = lines.filter(F.col("symbol").isin(list(symbols)) & (F.col("timeframe") == venue_timeframe(venue, timeframe)))
    return vendor_reader(venue)(own.drop("timeframe")).select("symbol", "ts", *REQUIRED)


def recorded(spark: SparkSession, path: str, venue: str, symbols: Sequence[str], timeframe: str) -> DataFrame:
    """Bars of all files there are now."""
    return _bars(spark.read.schema(f"{LINES[venue]}, symbol string, timeframe string").json(path), venue, symbols, timeframe)


def recorded_stream(spark: SparkSession, path: str, venue: str, symbols: Sequence[str], timeframe: str, files: int = 1000) -> DataFrame:
    """The same bars as a stream, at most `files` files a batch."""
    lines = spark.readStream.schema(f"{LINES[venue]}, symbol string, timeframe string").option("maxFilesPerTrigger", files).json(path)
    return _bars(lines, venue, symbols, timeframe)


def recent(bars: DataFrame, timeframe: str, limit: int, now: datetime) -> DataFrame:
    """The newest `limit` bars of each symbol within twice their span before now (as markets close), for a warm-up."""
    since = now - timedelta(seconds=2 * limit * seconds(timeframe))
    return last_n(bars.filter((F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") <= F.lit(now).cast("timestamp_ntz"))), limit)

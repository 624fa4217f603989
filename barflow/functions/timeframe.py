"""Timeframes such as 5m, 1h or 1d as seconds and bucket columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds by unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(timeframe: str) -> int:
    m = re.fullmatch(r"(\d+)([smhdw])", timeframe.strip().lower())
    if not m:
        raise ValueError(f"not a timeframe: {timeframe}")
    return int(m[1]) * UNITS[m[2]]


def floor_to(ts: Column, timeframe: str) -> Column:
    """Start of the bucket that holds ts (UTC epoch buckets)."""
    n = seconds(timeframe)
    epoch = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor(epoch / n) * n).cast("timestamp_ntz")


def next_close(ts: Column, timeframe: str) -> Column:
    return floor_to(ts, timeframe) + F.make_dt_interval(secs=F.lit(seconds(timeframe)))


def poll_seconds(timeframe: str) -> float:
    """How often a live feed looks for a closed bar: a quarter of the timeframe, from 2 to 30 seconds."""
    return min(max(seconds(timeframe) / 4, 2.0), 30.0)

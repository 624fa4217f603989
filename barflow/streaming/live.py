"""Structured Streaming: bars from ticks, duplicates, stateful averages and simulated positions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timeframe import seconds
from ..operators.fold import Bar, Simulator, event_frame
from ..schema import EVENT
from ..storage import shared_folder

AVERAGES = "symbol string, ts timestamp, close double, ema_fast double, ema_slow double, cross string"


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table's files as a stream; event times become zoned timestamps, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stem, last = table[:-1], table[-1]
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{stem}[{last}].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_bars(ticks: DataFrame, timeframe: str, delay: str = "0 seconds", price: str = "value", order: str = "event_id", size: str = "value") -> DataFrame:
    """Closed bars only: a bucket appears once the watermark has passed its end and is never revised."""
    w = F.window("ts", f"{seconds(timeframe)} seconds")
    out = ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.round(F.sum(size), 2).alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def dedup(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def crossing_averages(bars: DataFrame, fast: int = 9, slow: int = 21, seq: str | None = None) -> DataFrame:
    """Both averages and their crossings, kept as two numbers a symbol; a bar no newer than the last is ignored.

    seq: column of whole numbers that orders rows of one time; those are then
    rows of their own, and newer is what is later by time and seq.
    """

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        f, s, n, *last = state.get if state.exists else (None, None, 0, None, None)
        last = None if last[0] is None else tuple(last)
        rows = pd.concat(list(frames)).sort_values(["ts"] if seq is None else ["ts", seq], kind="stable")
        out = []
        for ts, place, close in zip(rows["ts"], [0] * len(rows) if seq is None else rows[seq], rows["close"], strict=True):
            at = (int(ts.value), int(place))
            if last is not None and at <= last:
                continue
            f0, s0 = f, s
            f = close if f is None else f + 2.0 / (fast + 1) * (close - f)
            s = close if s is None else s + 2.0 / (slow + 1) * (close - s)
            n, last = n + 1, at
            cross = None
            if n > slow:
                cross = "up" if f0 <= s0 and f > s else "down" if f0 >= s0 and f < s else None
            out.append((key[0], ts, close, f if n >= fast else None, s if n >= slow else None, cross))
        state.update((f, s, n, *(last or (None, None))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in AVERAGES.split(", ")])

    return bars.groupBy("symbol").applyInPandasWithState(step, AVERAGES, "fast double, slow double, n long, last long, seq long", "append", GroupStateTimeout.NoTimeout)


def live_positions(bars: DataFrame, cfg: dict[str, Any]) -> DataFrame:
    """The backtest's own fold over bars (columns of its rows) as they arrive, one account a run_id.

    All symbols of an account pass through one key, which serialises approvals;
    state is the pickled simulator without its past events.
    """
    import pickle

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        sim = pickle.loads(state.get[0]) if state.exists else Simulator(cfg)
        rows = pd.concat(list(frames)).sort_values(["ts", "symbol"])
        for r in rows.itertuples(index=False):
            x = json.loads(r.signal) if isinstance(r.signal, str) else None
            sim.step(Bar(r.symbol, r.asset_class, int(r.k), int(r.n), r.ts.to_pydatetime(), r.open, r.high, r.low, r.close, r.next_open, int(r.htf_rows), tuple(x[c] for c in ("side", "strategy", "entry", "stop", "take_profit", "conviction")) if x else None))
        out = event_frame(sim.events, key[0], EVENT)
        sim.events = []
        state.update((pickle.dumps(sim),))
        yield out

    return bars.groupBy("run_id").applyInPandasWithState(step, EVENT, "sim binary", "append", GroupStateTimeout.NoTimeout)


def replay(rows: list[DataFrame], name: str = "replay") -> DataFrame:
    """Batch frames as a stream of one micro-batch each, through files in the shared folder."""
    spark, path = rows[0].sparkSession, shared_folder(rows[0].sparkSession, name)
    for part in rows:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_available(stream: DataFrame, name: str = "stream") -> DataFrame:
    """All available input through the stream into parquet beside the checkpoints, and what was written."""
    spark = stream.sparkSession
    base = shared_folder(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/data").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def supervised(start: Callable[[], Any], stop: Callable[[], bool], first: float = 5.0, most: float = 120.0, sleep: Callable[[float], None] | None = None) -> int:
    """Run a query again whenever it fails, after twice the last pause up to a limit; returns the restarts."""
    import time

    pause, restarts = first, 0
    while not stop():
        try:
            start().awaitTermination()
            return restarts
        except Exception:  # the reason is in the query's own log
            (sleep or time.sleep)(pause)
            pause, restarts = min(pause * 2, most), restarts + 1
    return restarts

"""Bar sources: files, rows, ticks, vendor candles, event calendars, quotes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series
from ..functions.timeframe import seconds
from ..schema import BAR, REQUIRED

# Names that a first column of times may have.
TIME_NAMES = ("", "unnamed: 0", "time", "date", "datetime", "ts", "_c0")


def normalize_bars(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Find and parse the time column, check the required ones, carry the rest."""
    names = {c.lower(): c for c in df.columns}
    if "timestamp" in names:
        time = names["timestamp"]
    elif df.columns and df.columns[0].strip().lower() in TIME_NAMES:
        time = df.columns[0]
    else:
        raise ValueError(f"no time column among {df.columns}")
    if missing := set(REQUIRED) - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    t = df[time]
    parsed = t.cast("timestamp_ntz") if dict(df.dtypes)[time] != "string" else F.try_to_timestamp(t).cast("timestamp_ntz")
    clean = [F.nanvl(df[c].cast("double"), F.lit(None)).alias(c) for c in REQUIRED]
    own = [F.lit(symbol).alias("symbol")] if symbol is not None else [df["symbol"]] if "symbol" in df.columns else []
    rest = [df[c] for c in df.columns if c not in (time, "symbol", *REQUIRED)]
    return df.select(*own, parsed.alias("ts"), *clean, *rest)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars of a CSV or parquet file, ascending by time."""
    if path.lower().rstrip("/").endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).csv(path)
    return normalize_bars(df, symbol).orderBy("ts")


def rows_to_bars(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in BAR.split(", ")) for r in rows], BAR).orderBy("ts")


def ticks(events: DataFrame, rows: int = series.BLOCK_ROWS) -> DataFrame:
    """Prices from the events table: a walk in whole cents whose steps are the values, one symbol a type, summed in blocks of `rows`."""
    sign = F.when(F.floor(F.col("event_id") * 7919 / 13) % 2 == 0, 1).otherwise(-1)
    cents = sign * F.round(F.col("value") * 100).cast("long")
    order = ("ts", "event_id")
    cut = series.blocked(events.select("event_id", "ts", "event_type", "value"), ("event_type",), order, rows)
    walk = series.running(cut, {"walk": ("sum", cents)}, ("event_type",), order)
    return walk.select("event_id", "ts", F.col("event_type").alias("symbol"), (F.lit(200.0) + F.col("walk").cast("double") / 20000).alias("px"), "value")


def ticks_to_bars(rows: DataFrame, timeframe: str, price: str = "px", size: str = "value", order: str = "event_id", places: int | None = 2) -> DataFrame:
    """OHLCV by left-closed, left-labelled buckets; empty buckets have no row."""
    volume = F.sum(size) if places is None else F.round(F.sum(size), places)
    out = rows.groupBy("symbol", F.window("ts", f"{seconds(timeframe)} seconds").alias("_w")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.alias("volume"))
    return out.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe: first open, highest, lowest, last close, summed volume."""
    out = bars.groupBy("symbol", F.window("ts", f"{seconds(timeframe)} seconds").alias("_w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def date_range(bars: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    """Bars from start to end, both included; indicators computed on the result start afresh."""
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars if end is None else bars.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each symbol (warm-up fetches, retention of history)."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def crypto_candles(df: DataFrame) -> DataFrame:
    """Rows of [milliseconds, open, high, low, close, volume] arrays as bars."""
    at = lambda k: F.element_at("candle", k)
    return df.select("symbol", F.timestamp_millis(at(1).cast("long")).cast("timestamp_ntz").alias("ts"), *[at(k + 2).cast("double").alias(c) for k, c in enumerate(REQUIRED)])


def forex_candles(df: DataFrame) -> DataFrame:
    """Structs with time, complete, mid prices and volume as bars; candles still open are left out."""
    c = F.col("candle")
    return df.filter(c["complete"]).select("symbol", F.to_timestamp(c["time"]).cast("timestamp_ntz").alias("ts"), *[c["mid"][k[0]].cast("double").alias(k) for k in REQUIRED[:4]], c["volume"].cast("double").alias("volume"))


def vendor_reader(venue: str):  # noqa: ANN201
    """Normaliser of a venue's rows; feeds that need a network are for the caller to attach."""
    known = {"crypto": crypto_candles, "equity": normalize_bars, "forex": forex_candles}
    if venue not in known:
        raise ValueError(f"unknown venue: {venue}")
    return known[venue]


# Currencies whose events concern a symbol.
CURRENCIES = {"EUR_USD": ["EUR", "USD"], "GBP_USD": ["GBP", "USD"], "XAU_USD": ["USD"], "SPY": ["USD"], "QQQ": ["USD"], "BTC/USDT": ["USD"], "ETH/USDT": ["USD"]}


def calendar_events(rows: DataFrame) -> DataFrame:
    """Events with parsed time, upper-case currency and lower-case impact (high if absent); unreadable times are dropped."""
    when = F.try_to_timestamp(F.regexp_replace("time", "Z$", "+00:00")).cast("timestamp_ntz")
    return rows.select(when.alias("time"), F.upper("currency").alias("currency"), F.lower(F.coalesce("impact", F.lit("high"))).alias("impact"), "name").filter("time IS NOT NULL")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    from ..config import load_config

    rows = [(str(e.get("time")), e.get("currency"), e.get("impact"), e.get("name")) for e in load_config(path).get("events", [])]
    return calendar_events(spark.createDataFrame(rows, "time string, currency string, impact string, name string"))


#: Rows up to which a dimension is broadcast.
SMALL_ROWS = 100_000


def small(dimension: DataFrame) -> DataFrame:
    """The dimension as a broadcast side if its rows, counted, are few; otherwise a join with it shuffles."""
    return F.broadcast(dimension) if dimension.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else dimension


def latest(df: DataFrame, key: str = "symbol", order: str | Column = "ts") -> DataFrame:
    """The newest row of each key: quotes, positions, live signals."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order) if isinstance(order, str) else order).alias("_x")).select(key, *[F.col("_x")[c].alias(c) for c in rest])

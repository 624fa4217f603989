"""Recorded candles of each venue: as a table, as a stream over restarts, and the look-back of a warm-up."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barflow.sources import bars, feed

BEGIN = datetime(2024, 3, 1)


def candles(spark, sf_dir):
    ticks = bars.ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return bars.ticks_to_bars(ticks, "15m").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def lines(rows, venue):
    """The venue's form of bars."""
    zoned = F.col("ts").cast("timestamp")
    if venue == "crypto":
        return rows.select("symbol", F.array(F.unix_millis(zoned).cast("double"), "open", "high", "low", "close", "volume").alias("candle"))
    if venue == "equity":
        return rows.select("symbol", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "open", "high", "low", "close", "volume")
    mid = F.struct(*[F.col(c).cast("string").alias(c[0]) for c in ("open", "high", "low", "close")])
    return rows.select("symbol", F.struct(F.date_format(zoned, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.lit(True).alias("complete"), mid.alias("mid"), F.round("volume").cast("long").alias("volume")).alias("candle"))


def record(rows, venue, path, timeframe="15m"):
    lines(rows, venue).withColumn("timeframe", F.lit(feed.venue_timeframe(venue, timeframe))).write.mode("append").partitionBy("symbol", "timeframe").json(path)


def rows_of(df):
    return sorted((r.symbol, r.ts, r.open, r.high, r.low, r.close) for r in df.collect())


@pytest.mark.parametrize("venue", ["crypto", "equity", "forex"])
def test_stream_over_restarts_equals_the_table(spark, sf_dir, tmp_path, venue):
    every = candles(spark, sf_dir).persist()
    symbols = sorted(r.symbol for r in every.select("symbol").distinct().collect())[:2]
    path, out, mark = (str(tmp_path / x) for x in ("lines", "bars", "mark"))
    for part in range(3):
        record(every.filter(F.pmod(F.xxhash64("ts"), F.lit(3)) == part), venue, path)
        record(every.limit(5), venue, path, "1h")  # another timeframe, not asked for
        stream = feed.recorded_stream(spark, path, venue, symbols, "15m", files=2)
        stream.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).trigger(availableNow=True).start().awaitTermination(120)
    want = rows_of(every.filter(F.col("symbol").isin(symbols)))
    assert want and rows_of(spark.read.parquet(out)) == want == rows_of(feed.recorded(spark, path, venue, symbols, "15m"))
    every.unpersist()


def test_pairs_with_a_slash_open_candles_and_pruned_folders(spark, tmp_path):
    path = str(tmp_path / "lines")
    one = spark.createDataFrame([("BTC/USDT", BEGIN, 1.0, 2.0, 0.5, 1.5, 10.0)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    record(one, "forex", path)
    lines(one, "forex").withColumn("candle", F.col("candle").withField("complete", F.lit(False))).withColumn("timeframe", F.lit("M15")).write.mode("append").partitionBy("symbol", "timeframe").json(path)
    got = feed.recorded(spark, path, "forex", ["BTC/USDT"], "15m")
    assert rows_of(got) == [("BTC/USDT", BEGIN, 1.0, 2.0, 0.5, 1.5)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_look_back(spark):
    rows = [("A", BEGIN + timedelta(minutes=15 * k), *[float(k)] * 5) for k in range(40)] + [("B", BEGIN, *[1.0] * 5)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    got = feed.recent(df, "15m", 5, BEGIN + timedelta(minutes=15 * 20)).collect()
    assert sorted(r.close for r in got) == [16.0, 17.0, 18.0, 19.0, 20.0] and {r.symbol for r in got} == {"A"}


def test_names_of_timeframes():
    assert [feed.venue_timeframe(v, t) for v in ("crypto", "equity", "forex") for t in ("15m", "4h", "1d")] == ["15m", "4h", "1d", "15Min", "4Hour", "1Day", "M15", "H4", "D"]
    for bad in ("", "m", "5x", "2w"):
        with pytest.raises(ValueError, match="unsupported"):
            feed.venue_timeframe("equity", bad)

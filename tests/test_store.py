"""Stored bars: ranges read their days only, windows by symbol need no exchange."""

import datetime as dt

import pytest

from barflow.operators import indicators as ind
from barflow.operators.asof import asof_backward
from barflow.sources import bars as src
from barflow.sources.store import store_bars, stored_bars

T0 = dt.datetime(2024, 5, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, T0 + dt.timedelta(hours=k), 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 10.0) for s in ("A", "B", "C", None) for k in range(72)] + [("A", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    spark.sql("DROP TABLE IF EXISTS bars_of_test")
    store_bars(df.filter("ts IS NULL OR ts < '2024-05-03'"), "bars_of_test", 4)
    store_bars(df.filter("ts >= '2024-05-03'"), "bars_of_test", 4, "append")
    yield df
    spark.sql("DROP TABLE bars_of_test")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ranges_prune_days(spark, bars):
    some = stored_bars(spark, "bars_of_test", "2024-05-02 03:00:00", "2024-05-02 20:00:00")
    assert rows(some) == rows(src.date_range(bars, "2024-05-02 03:00:00", "2024-05-02 20:00:00")) and some.count() == 4 * 18
    assert "PartitionFilters: [isnotnull(day" in plan(some) and "day" not in some.columns
    assert rows(stored_bars(spark, "bars_of_test")) == rows(bars.select(*stored_bars(spark, "bars_of_test").columns))


def test_windows_need_no_exchange(spark, bars):
    out = stored_bars(spark, "bars_of_test", "2024-05-01").withColumn("sma", ind.sma("close", 5))
    assert "Exchange" not in plan(out) and "Window" in plan(out)
    want = src.date_range(bars, "2024-05-01").withColumn("sma", ind.sma("close", 5))
    assert rows(out.select("symbol", "ts", "sma")) == rows(want.select("symbol", "ts", "sma"))


def test_asof_of_stored_bars(spark, bars):
    left = stored_bars(spark, "bars_of_test", "2024-05-02").select("symbol", "ts", "close")
    right = stored_bars(spark, "bars_of_test", "2024-05-01").filter("hour(ts) % 4 = 0").select("symbol", "ts", "open")
    out = asof_backward(left, right, "symbol", "ts", None)
    assert {(r.symbol, r.ts, r.open) for r in out.collect()} == {(s, T0 + dt.timedelta(hours=k), 1.0 + k // 4 * 4) for s in ("A", "B", "C", None) for k in range(24, 72)}

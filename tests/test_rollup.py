"""All levels equal direct resampling, whatever the order in which rows come; only touched days are made again."""

import datetime as dt
import os

import numpy as np
import pytest

from barflow.sources import bars as src
from barflow.sources.rollup import Pyramid

T0 = dt.datetime(2024, 3, 1)
LEVELS = ("1m", "5m", "1h", "1d")


def ticks(spark, n=600, seed=2):
    rng = np.random.default_rng(seed)
    rows = [("AB"[int(rng.integers(2))], T0 + dt.timedelta(seconds=float(s)), float(100 + rng.standard_normal()), float(rng.integers(1, 9)), k) for k, s in enumerate(np.sort(rng.uniform(0, 4 * 86_400, n)))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, px double, value double, event_id long")


def plain(df):
    return {(r.symbol, r.ts): tuple(round(r[c], 9) for c in ("open", "high", "low", "close", "volume")) for r in df.collect()}


def written(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_levels_after_late_rows_in_random_order(spark, tmp_path):
    rows = ticks(spark).cache()
    order = np.random.default_rng(4).permutation(5)
    pyramid = Pyramid(spark, str(tmp_path), LEVELS)
    for batch, k in enumerate(order):
        pyramid.add(rows.filter(f"event_id * 31 % 5 = {k}"), batch)
    for level in LEVELS:
        assert plain(pyramid.bars(level)) == plain(src.ticks_to_bars(rows, level, places=None)), level
    pyramid.add(rows.filter("event_id < 50"), 0)  # a batch that was there already
    assert plain(pyramid.bars("1h")) == plain(src.ticks_to_bars(rows, "1h", places=None))


def test_only_touched_days_are_made_again(spark, tmp_path):
    rows = ticks(spark)
    pyramid = Pyramid(spark, str(tmp_path), LEVELS)
    pyramid.add(rows.filter("event_id % 7 > 0"), 0)
    before = written(f"{tmp_path}/1h")
    late = rows.filter("event_id % 7 = 0 AND day(ts) = 2")
    assert pyramid.add(late, 1) == [dt.date(2024, 3, 2)]
    after = written(f"{tmp_path}/1h")
    assert {p for p in before if before[p] == after.get(p)} == {p for p in before if "day=2024-03-02" not in p}
    want = src.ticks_to_bars(rows.filter("event_id % 7 > 0 OR day(ts) = 2"), "1d", places=None)
    assert plain(pyramid.bars("1d")) == plain(want)


def test_a_failed_refresh_is_run_again(spark, tmp_path, monkeypatch):
    rows = ticks(spark, 200)
    pyramid = Pyramid(spark, str(tmp_path), LEVELS)
    monkeypatch.setattr(pyramid, "refresh", lambda days: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        pyramid.add(rows, 0)
    monkeypatch.undo()
    pyramid.add(rows, 0)
    assert plain(pyramid.bars("5m")) == plain(src.ticks_to_bars(rows, "5m", places=None))


def test_ranges_read_their_days_only(spark, tmp_path):
    rows = ticks(spark)
    pyramid = Pyramid(spark, str(tmp_path), LEVELS)
    pyramid.add(rows, 0)
    for level in ("1m", "1h"):
        some = pyramid.bars(level, "2024-03-02 06:00:00", "2024-03-03")
        want = src.date_range(src.ticks_to_bars(rows, level, places=None), "2024-03-02 06:00:00", "2024-03-03")
        assert plain(some) == plain(want)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan
    with pytest.raises(ValueError, match="divide"):
        Pyramid(spark, str(tmp_path), ("1m", "7m"))
    assert pyramid.add(rows.filter("false"), 9) == []

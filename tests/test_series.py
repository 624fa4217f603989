"""Series with gaps, and series cut into blocks of a few rows, against plain pandas and against themselves whole."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from barflow.config import DEFAULTS
from barflow.functions import series
from barflow.functions.ewm import Mean, ema, ewm, wilder
from barflow.operators import indicators as ind
from barflow.operators import signals

T0 = dt.datetime(2024, 1, 1)


def gappy(n, seed, share=0.3):
    """Values with NULLs at the start, inside, in runs and at the end."""
    rng = np.random.default_rng(seed)
    x = 100 + np.cumsum(rng.standard_normal(n))
    gone = rng.random(n) < share
    gone[:3] = gone[-4:] = True
    gone[n // 3 : n // 3 + n // 5] = True
    return [None if g else float(v) for v, g in zip(x, gone)]


def frame(spark, columns, symbol="A"):
    n = len(next(iter(columns.values())))
    rows = [(symbol, T0 + dt.timedelta(minutes=k), *[c[k] for c in columns.values()]) for k in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in columns))


def got(df, name):
    return np.array([np.nan if r[0] is None else r[0] for r in df.orderBy("ts").select(name).collect()], float)


@pytest.mark.parametrize("rows", [series.BLOCK_ROWS, 7])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.9])
def test_averages_over_gaps_equal_pandas(spark, rows, share):
    x, z = gappy(150, 1, share), gappy(150, 2, share)
    df = series.blocked(frame(spark, {"x": x, "z": z}), rows=rows)
    assert series.is_blocked(df) == (rows == 7)
    means = [Mean("x", 0.3, 2, "a"), ema("x", 21, "b"), wilder("z", 14, "c"), ema("z", 1, "d"), wilder("x", 14, "e")]
    out = ewm(df, means)
    for m in means:
        want = pd.Series(x if m.source == "x" else z, dtype=float).ewm(alpha=m.alpha, adjust=False, min_periods=m.needs).mean()
        np.testing.assert_allclose(got(out, m.name), want, rtol=1e-10)


def test_nan_is_a_gap(spark):
    out = ewm(frame(spark, {"x": [1.0, float("nan"), 3.0]}), [Mean("x", 0.5, 1, "y")])
    np.testing.assert_allclose(got(out, "y"), pd.Series([1.0, None, 3.0]).ewm(alpha=0.5, adjust=False).mean())


def plain(bars):
    """The oscillators by the recursion, in pandas."""
    p = bars.orderBy("ts").toPandas()
    w = lambda s, n: s.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    before = p.close.shift(1)
    tr = pd.concat([p.high - p.low, (p.high - before).abs(), (p.low - before).abs()], axis=1).max(axis=1)
    change = p.close.diff()
    gain, loss = w(change.clip(lower=0), 14), w(-change.clip(upper=0), 14)
    rise, fall = p.high.diff(), -p.low.diff()
    up, down = pd.Series(np.where((rise > fall) & (rise > 0), rise, 0.0)), pd.Series(np.where((fall > rise) & (fall > 0), fall, 0.0))
    a, b = 100 * w(up, 14) / w(tr, 14), 100 * w(down, 14) / w(tr, 14)
    dx = 100 * (a - b).abs() / (a + b).replace(0, np.nan)
    return {"ema_fast": p.close.ewm(span=9, adjust=False, min_periods=9).mean(), "rsi": (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(50.0), "atr": w(tr, 14), "adx": w(dx, 14)}


@pytest.fixture(scope="module")
def bars(spark):
    close = gappy(260, 3, 0.1)
    rng = np.random.default_rng(4)
    side = lambda sign: [None if c is None or rng.random() < 0.05 else c + sign * abs(rng.standard_normal()) for c in close]
    return frame(spark, {"open": close, "high": side(1), "low": side(-1), "close": close, "volume": [float(v) for v in rng.integers(1, 9, 260)]})


def test_indicators_over_gaps_equal_the_recursion(bars):
    out = ind.add_all_indicators(bars)
    for name, want in plain(bars).items():
        np.testing.assert_allclose(got(out, name), want, rtol=1e-9, err_msg=name)
    for f, name in ((ind.rsi, "rsi"), (ind.atr, "atr"), (ind.adx, "adx")):
        np.testing.assert_allclose(got(f(bars), name), plain(bars)[name], rtol=1e-9)


ALL = ["ema_fast", "ema_slow", "rsi", "atr", "adx", "bb_mid", "bb_upper", "bb_width", "support", "resistance", "vol_surge", "atr_pct", "support_30"]


def test_indicators_of_one_symbol_in_blocks(spark, bars):
    """Frames longer than a block, and shorter ones."""
    cut = series.blocked(bars, rows=(rows := 16))
    assert cut.groupBy("_block").count().agg({"count": "max"}).first()[0] == rows
    out, want = ind.add_all_indicators(cut, ranges=[30]), ind.add_all_indicators(bars, ranges=[30])
    assert set(series.whole(out).columns) == set(want.columns) and out.count() == 260
    for name in ALL:
        np.testing.assert_allclose(got(out, name), got(want, name), rtol=1e-9, err_msg=name)
    for f in (ind.rsi, ind.atr, ind.adx):
        np.testing.assert_allclose(got(f(cut), f.__name__), got(want, f.__name__), rtol=1e-9)


def test_signals_in_blocks(spark):
    rng = np.random.default_rng(9)
    close = 100 + np.cumsum(rng.standard_normal(600))
    b = frame(spark, {"open": close.tolist(), "high": (close + 0.4).tolist(), "low": (close - 0.4).tolist(), "close": close.tolist(), "volume": rng.integers(1, 90, 600).astype(float).tolist()})
    long = b.filter("minute(ts) % 4 = 0")
    made = lambda x, y: series.whole(signals.with_signals(signals.enrich(x, y))).select("ts", "n", "regime", "htf_rows", "htf_close", "momentum", "mean_reversion", "breakout", "signal").orderBy("ts").collect()
    whole, cut = made(b, long), made(series.blocked(b, rows=50), series.blocked(long, rows=20))
    assert sum(r.breakout is not None or r.mean_reversion is not None for r in whole) >= 3
    for x, y in zip(whole, cut, strict=True):
        assert (x.ts, x.n, x.regime, x.htf_rows) == (y.ts, y.n, y.regime, y.htf_rows)
        for c in ("momentum", "mean_reversion", "breakout", "signal"):
            assert (x[c] is None) == (y[c] is None), (c, x.ts)
            if x[c] is not None:
                assert x[c].side == y[c].side and x[c].stop == pytest.approx(y[c].stop) and x[c].conviction == pytest.approx(y[c].conviction)


def test_blocks_of_several_keys_ties_and_nulls(spark):
    rows = [("A", T0)] * 9 + [("A", T0 + dt.timedelta(hours=k)) for k in range(30)] + [(None, T0), (None, None), ("B", None)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz")
    out = series.blocked(df, rows=10).collect()
    assert len(out) == len(rows) and sorted(r._i for r in out if r.symbol == "A") == list(range(39)) and {r._i for r in out if r.symbol is None} == {0, 1}
    assert series.blocked(df.filter("false"), rows=10).count() == 0
    assert DEFAULTS["breakout"]["lookback"] <= signals.REACH


def test_running_values_in_blocks(spark):
    x = gappy(120, 5, 0.4)
    df = frame(spark, {"x": x})
    p = pd.Series(x, dtype=float)
    values = {"total": ("sum", "x"), "top": ("max", "x"), "low": ("min", "x"), "held": ("last", "x")}
    for rows in (series.BLOCK_ROWS, 9):
        out = series.running(series.blocked(df, rows=rows), values)
        want = {"total": p.cumsum().ffill(), "top": p.cummax().ffill(), "low": p.cummin().ffill(), "held": p.ffill()}
        for name, w in want.items():
            np.testing.assert_allclose(got(out, name), w, rtol=1e-12, err_msg=name)


@pytest.mark.parametrize("rows", [None, 40, 3])
def test_asof_of_one_hot_symbol(spark, rows):
    """Cells of a few rows, cells without right rows, rows before the first, equal times, null times and keys."""
    from barflow.operators.asof import asof_backward

    rng = np.random.default_rng(7)
    at = lambda k: T0 + dt.timedelta(seconds=int(k))
    left = [("A", at(k), i) for i, k in enumerate(np.sort(rng.integers(0, 900, 150)))] + [(None, at(5), 900), ("B", at(0), 901), ("A", None, 902)]
    right = [("A", at(k), 1000 + i, None) for i, k in enumerate(np.unique(rng.integers(100, 400, 40)))] + [("A", at(800), 2000, 1.5), (None, at(4), 3000, None), ("C", at(0), 4000, None)]
    a, b = spark.createDataFrame(left, "symbol string, ts timestamp_ntz, i long"), spark.createDataFrame(right, "symbol string, ts timestamp_ntz, r long, q double")
    found = {r.i: (r.r, r.q) for r in asof_backward(a, b, "symbol", "ts", rows).collect()}
    assert len(found) == len(left)
    for s, t, i in left:
        past = [(u, r, q) for k, u, r, q in right if k == s and t is not None and u <= t]
        assert found[i] == (max(past)[1:] if past else (None, None))


def test_equity_and_falls_of_a_long_run(spark):
    from barflow.operators import metrics as mt

    rng = np.random.default_rng(8)
    rows = [("r", T0, T0 + dt.timedelta(hours=int(k // 3)), float(rng.normal(0, 900)), int(k)) for k in range(300)]
    tr = spark.createDataFrame(rows, "run_id string, entry_time timestamp_ntz, exit_time timestamp_ntz, pnl double, seq long")
    one, many = (sorted((r.step, round(r.equity, 6)) for r in mt.equity_curve(tr, rows=n).collect()) for n in (1000, 16))
    assert one == many and len(one) == 301
    curve = mt.daily_returns(mt.equity_curve(tr))
    a, b = (mt.drawdown(curve, rows=n).first() for n in (None, 3))
    assert a.max_dd_pct == pytest.approx(b.max_dd_pct) and a.max_dd_abs == pytest.approx(b.max_dd_abs) and a.max_dd_abs > 0


def test_ticks_of_one_type_in_blocks(spark):
    from barflow.sources.bars import ticks

    rng = np.random.default_rng(10)
    rows = [(int(k), T0 + dt.timedelta(seconds=int(k // 2)), "view", float(rng.random() * 100)) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    a, b = ({r.event_id: r.px for r in ticks(df, n).collect()} for n in (1000, 13))
    assert a == b and len(a) == 200


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_paths_in_blocks(spark, block):
    from barflow.operators import metrics as mt

    rng = np.random.default_rng(11)
    r = rng.normal(0, 0.2, 50)
    returns = spark.createDataFrame([(i, float(x)) for i, x in enumerate(r)], "idx long, r double")
    draws = {run: rng.integers(0, 50, 40) for run in range(6)}
    df = spark.createDataFrame([(run, k, int(i)) for run, d in draws.items() for k, i in enumerate(d)], "run long, k long, idx long")
    for x in mt.mc_paths(df, returns, 1000.0, 0.5, block).collect():
        equity = 1000 + np.cumsum(r[draws[x.run]] * 1000)
        peak = np.maximum(np.maximum.accumulate(equity), 1000)
        assert x.final_equity == pytest.approx(equity[-1]) and x.max_dd == pytest.approx(max(((peak - equity) / peak).max(), 0)) and x.ruined == (min(equity.min(), 1000) <= 500)

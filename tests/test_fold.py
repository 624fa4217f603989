import datetime as dt

import pytest

from barflow.config import expand_grid, set_path, substitute_env, with_settings
from barflow.functions.timeframe import poll_seconds, seconds
from barflow.operators import metrics as mt
from barflow.operators.fold import Bar, Position, Simulator

T0 = dt.datetime(2024, 1, 1)


def bar(k, close, high=None, low=None, signal=None, symbol="BTC/USDT", n=50, open_=None, next_open=None, cls="crypto"):
    return Bar(symbol, cls, k, n, T0 + dt.timedelta(hours=k), open_ or close, high or close, low or close, close, next_open or close, 100, signal)


def sim(**cfg):
    return Simulator(with_settings(backtest__warmup=0, backtest__fee_bps=0.0, backtest__slippage_bps=0.0, **cfg))


LONG = ("long", "momentum", 100.0, 99.0, 104.0, 0.7)


def test_signal_fills_two_bars_later_and_exits_at_stop():
    s = sim()
    s.step(bar(0, 100, signal=LONG))
    assert "BTC/USDT" in s.pending and not s.positions
    s.step(bar(1, 100, next_open=100.5))
    assert s.positions["BTC/USDT"].entry == 100.5
    s.step(bar(2, 99.5, high=101, low=98))
    trade = [e for e in s.events if e["kind"] == "trade"][0]
    assert (trade["exit_price"], trade["reason"], trade["entry_time"]) == (99.0, "stop", T0 + dt.timedelta(hours=1))


def test_target_end_of_data_and_stop_beyond_fill():
    s = sim()
    s.positions["BTC/USDT"] = Position("long", "m", "crypto", 1.0, 100.0, 99.0, 104.0, 99.0, 100.0, T0)
    s.step(bar(1, 104.5, high=105, low=104.1))
    assert s.events[0]["reason"] == "take_profit" and s.events[0]["exit_price"] == 104.0
    s = sim()
    s.step(bar(47, 100, signal=LONG))
    s.step(bar(48, 100, next_open=98.0))  # the stop is no longer below the fill
    assert not s.positions
    s.positions["BTC/USDT"] = Position("short", "m", "crypto", 2.0, 100.0, 105.0, 90.0, 105.0, 100.0, T0)
    s.step(bar(49, 97))
    assert s.events[-1]["reason"] == "end_of_data" and s.events[-1]["pnl"] == pytest.approx(6.0)


def test_trailing_only_tightens():
    s = sim()
    s.positions["BTC/USDT"] = Position("long", "m", "crypto", 1.0, 100.0, 99.0, 120.0, 99.0, 100.0, T0)
    s.step(bar(1, 102, low=101.5))
    assert s.positions["BTC/USDT"].stop == 101.0
    s.step(bar(2, 101.6, low=101.2))
    assert s.positions["BTC/USDT"].stop == 101.0


def test_gates_in_order():
    s = sim()
    reason = lambda sig, **k: s.approve(bar(0, 100, **k), sig)[0]
    assert reason(("long", "m", 100.0, 99.0, 101.5, 0.7)) == "reward_risk"
    assert reason(LONG) is None
    assert reason(("long", "m", 100.0, 101.0, 104.0, 0.7)) == "stop_side"
    for other in ("A", "B", "C"):
        s.positions[other] = Position("long", "m", "other", 1, 1, 1, 1, 1, 1, T0)
    assert reason(LONG) == "max_positions"
    s.positions = {"ETH/USDT": Position("long", "m", "crypto", 1, 1, 1, 1, 1, 1, T0)}
    assert reason(LONG) == "cluster"
    s.positions = {x: Position("long", "m", "crypto", 1, 1, 1, 1, 1, 1, T0) for x in ("X", "Y")}
    assert reason(LONG) == "class_cap"
    s.positions = {"BTC/USDT": Position("long", "m", "crypto", 1, 1, 1, 1, 1, 1, T0)}
    assert reason(LONG) == "already_open"


def test_size_grows_with_conviction_and_is_bounded():
    s = sim()
    q = [s.approve(bar(0, 100), ("long", "m", 100.0, 99.0, 104.0, c))[1] for c in (0.1, 0.5, 1.0)]
    assert q == sorted(q) and q[-1] * 1.0 <= 1000.0 + 1e-9
    assert s.approve(bar(0, 100), ("long", "m", 100.0, 99.999, 104.0, 1.0))[1] == 1000.0


def test_daily_halt_holds_for_the_day():
    s = sim()
    s.step(bar(0, 100))
    s.realised = -5000.0
    s.step(bar(1, 100, signal=LONG))
    assert s.daily_halt and not s.pending and s.approve(bar(1, 100), LONG)[0] == "daily_halt"
    s.step(bar(24, 100))
    assert not s.daily_halt and not s.weekly_halt


def test_windows_grid_and_settings():
    w = mt.make_windows(dt.datetime(2023, 1, 1), dt.datetime(2024, 12, 31))
    assert len(w) == 4 and w[1]["test_start"] == dt.datetime(2023, 9, 1) and w[1]["train_start"] == dt.datetime(2023, 3, 1)
    assert mt.add_months(dt.datetime(2024, 1, 31), 1) == dt.datetime(2024, 2, 29)
    assert len(expand_grid({"a": [1, 2, 3], "b": [1, 2], "c.d": [0]})) == 6
    assert set_path({}, "ema_fast", 7) == {"momentum": {"ema_fast": 7}}
    assert substitute_env({"a": ["${X}-${Y}"]}, {"X": "1"}) == {"a": ["1-"]}
    assert seconds("15M") == 900 and poll_seconds("1h") == 30.0 and poll_seconds("5s") == 2.0
    with pytest.raises(ValueError):
        seconds("5x")

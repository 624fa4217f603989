"""The search for fills against a walk over every later bar."""

import datetime as dt
import random

import pytest

from barflow.operators.execution import first_fills

START = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp, open double, high double, low double, close double"
ORDER = "order_id long, symbol string, ts timestamp, side string, type string, qty double, limit_price double, stop_price double"


def walk(order, bars):
    for symbol, ts, o, high, low, _ in sorted(bars, key=lambda b: b[1]):
        _, s, sent, side, kind, _, limit, stop = order
        if symbol != s or ts <= sent:
            continue
        if kind == "market" and o is not None:
            return ts, o
        if kind == "limit" and side and limit is not None and (low <= limit if side == "buy" else high >= limit):
            return ts, (min if side == "buy" else max)(x for x in (limit, o) if x is not None)
        if kind == "stop" and side and stop is not None and (high >= stop if side == "buy" else low <= stop):
            return ts, (max if side == "buy" else min)(x for x in (stop, o) if x is not None)
    return None


@pytest.mark.parametrize("n", [1, 32, 33, 1500])
def test_first_fills_as_walked(spark, n):
    rng, bars, price = random.Random(n), [], 100.0
    for symbol, count in (("A", n), ("B", n // 2)):
        for k in range(count):
            price += rng.gauss(0, 0.3)
            bars.append((symbol, START + dt.timedelta(minutes=k), None if k % 17 == 3 else price, price + rng.random(), price - rng.random(), price))
    orders = [
        (k, rng.choice("ABC"), START + dt.timedelta(minutes=rng.randint(-2, n), seconds=rng.choice((0, 30))), rng.choice(("buy", "sell", None)), rng.choice(("market", "limit", "stop", "odd")), 1.0, rng.choice((None, price + rng.gauss(0, 6))), price + rng.gauss(0, 6))
        for k in range(300)
    ]
    got = {r.order_id: (r.bar_ts, round(r.fill_price, 9)) for r in first_fills(spark.createDataFrame(orders, ORDER), spark.createDataFrame(bars, BAR), bps=0.0).collect() if r.fill_price is not None}
    want = {o[0]: (f[0], round(f[1], 9)) for o in orders if (f := walk(o, bars))}
    assert got == want


def test_no_bars_no_orders(spark):
    orders = spark.createDataFrame([(1, "A", START, "buy", "market", 1.0, None, None)], ORDER)
    bars = spark.createDataFrame([("A", START + dt.timedelta(minutes=1), 1.0, 1.0, 1.0, 1.0)], BAR)
    assert first_fills(orders, bars.limit(0)).count() == 0 and first_fills(orders.limit(0), bars).count() == 0
    assert first_fills(orders, bars).count() == 1


def test_limit_prices_by_another_rule_of_valid_quotes(spark):
    """A quote around zero is no missing quote where the caller says so; the default rule stays."""
    from pyspark.sql import functions as F

    from barflow.operators.execution import limit_price

    df = spark.createDataFrame([("buy", -0.005, 0.005, True), ("sell", -2.0, -1.0, True), ("buy", 99.0, 101.0, True), ("buy", 0.0, 1.0, False), ("sell", None, 1.0, True)], "side string, bid double, ask double, there boolean")
    got = df.select(limit_price(10.0, F.col("there")), limit_price(10.0)).collect()
    assert [r[0] for r in got] == [0.0, pytest.approx(-1.5015), pytest.approx(99.9), None, None]
    assert [r[1] for r in got] == [None, None, pytest.approx(99.9), None, None]

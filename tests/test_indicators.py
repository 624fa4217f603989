import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.functions.ewm import Mean, ema, ewm, wilder
from barflow.operators import indicators as ind
from barflow.operators import signals
from barflow.schema import BAR


def make(spark, high, low, close, volume=None, symbol="A"):
    t0 = dt.datetime(2024, 1, 1)
    volume = volume if volume is not None else [1000.0] * len(close)
    rows = [(symbol, t0 + dt.timedelta(minutes=5 * k), float(c), float(h), float(lo), float(c), float(v)) for k, (h, lo, c, v) in enumerate(zip(high, low, close, volume))]
    return spark.createDataFrame(rows, BAR)


def walk(spark, n=200, seed=42):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(0.5 * rng.standard_normal(n))
    return make(spark, close + abs(0.3 * rng.standard_normal(n)), close - abs(0.3 * rng.standard_normal(n)), close, rng.integers(1000, 5000, n))


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def test_sma_needs_a_full_frame(spark):
    x = [1, 2, 3, 4, 5]
    assert column(make(spark, x, x, x).withColumn("s", ind.sma("close", 3)), "s") == [None, None, 2.0, 3.0, 4.0]


def test_ema_of_constant_and_step(spark):
    flat = [5.0] * 50
    assert column(ewm(make(spark, flat, flat, flat), [ema("close", 10, "e")]), "e")[-1] == pytest.approx(5.0)
    step = [1.0] * 20 + [10.0] * 20
    e = column(ewm(make(spark, step, step, step), [ema("close", 5, "e")]), "e")
    assert e[19] == pytest.approx(1.0) and e[39] > 8


@pytest.mark.parametrize("period", [1, 2, 9, 14, 50])
def test_block_scan_equals_pandas(spark, period):
    b = walk(spark, 500)
    p = b.orderBy("ts").toPandas()["close"]
    for mean, alpha in ((ema("close", period, "y"), 2 / (period + 1)), (wilder("close", period, "y"), 1 / period)):
        want = p.ewm(alpha=alpha, adjust=False, min_periods=period).mean()
        got = pd.Series(column(ewm(b, [mean]), "y"), dtype=float)
        np.testing.assert_allclose(got, want, rtol=1e-12)


def test_gaps_follow_pandas(spark):
    x = [1.0, None, None, 4.0, 2.0, None, 3.0]
    rows = [("A", dt.datetime(2024, 1, 1, 0, k), v) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double")
    got = column(ewm(df, [Mean("x", 0.3, 2, "y")]), "y")
    want = pd.Series(x, dtype=float).ewm(alpha=0.3, adjust=False, min_periods=2).mean()
    np.testing.assert_allclose(pd.Series(got, dtype=float), want)


def test_true_range(spark):
    assert column(make(spark, [10, 12, 11], [9, 10, 9.5], [9.5, 11, 10]).withColumn("tr", ind.true_range()), "tr") == [1.0, 2.5, 1.5]


def test_rsi_adx_bounds_and_trends(spark):
    w = walk(spark)
    assert all(0 <= v <= 100 for v in column(ind.rsi(w), "rsi"))
    a = [v for v in column(ind.adx(w), "adx") if v is not None]
    assert len(a) == 200 - 26 and all(0 <= v <= 100 for v in a)
    line = np.linspace(100, 150, 200)
    t = [v for v in column(ind.adx(make(spark, line + 0.5, line - 0.5, line)), "adx") if v is not None]
    assert np.mean(t) > np.mean(a)
    for sign, seed in ((1, 0), (-1, 1)):
        c = 100 + np.cumsum(np.random.default_rng(seed).normal(0.3 * sign, 1, 200))
        r = np.mean(column(ind.rsi(make(spark, c, c, c)), "rsi"))
        assert (r > 50) == (sign > 0)


def test_bands_surge_and_levels(spark):
    rows = walk(spark).withColumns(ind.bollinger()).filter("bb_mid IS NOT NULL").collect()
    assert all(r.bb_lower <= r.bb_mid <= r.bb_upper and r.bb_width >= 0 for r in rows)
    flat = [1.0] * 31
    assert column(make(spark, flat, flat, flat, [100] * 30 + [500]).withColumn("v", ind.volume_surge()), "v")[-1] == pytest.approx(500 / 120)
    x = [10, 11, 12, 13, 100]
    last = make(spark, x, x, x).withColumns(ind.support_resistance(4)).orderBy(F.desc("ts")).first()
    assert (last.resistance, last.support) == (13.0, 10.0)


def test_regimes(spark):
    def label(b, **cfg):
        from barflow.config import with_settings

        c = with_settings(regime__atr_high_vol_pct=4.0)
        return column(ind.add_all_indicators(b, c).withColumn("r", signals.regime(c)), "r")[-1]

    up = np.linspace(100, 150, 200)
    assert label(make(spark, up + 0.3, up - 0.3, up)) == "trending"
    rng = np.random.default_rng(1)
    flat = 100 + 0.5 * np.sin(np.linspace(0, 8 * np.pi, 200)) + 0.05 * rng.standard_normal(200)
    assert label(make(spark, flat + 0.1, flat - 0.1, flat)) in ("ranging", "unknown")
    rng = np.random.default_rng(2)
    wild = 200 + np.cumsum(5 * rng.standard_normal(200))
    assert label(make(spark, wild + abs(5 * rng.standard_normal(200)), wild - abs(5 * rng.standard_normal(200)), wild)) != "trending"


def test_returns_over_a_change_of_sign_are_no_numbers(spark):
    """A window that holds an undefined return is undefined; it was summed without it."""
    import datetime as dt
    import math

    from barflow.operators import ml

    closes = [2.0, 1.0, -1.0, -2.0, 0.0, 3.0, 6.0, None, 6.0]
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, k), c) for k, c in enumerate(closes)], "symbol string, ts timestamp_ntz, close double")
    r = ml.log_returns((1, 2))
    got = df.withColumn("_lr", r.pop("_lr")).select("ts", *[c.alias(n) for n, c in r.items()]).orderBy("ts").collect()
    two = math.log(2)
    want = [(None, None), (-two, -two), (math.nan, math.nan), (two, math.nan), (-math.inf, -math.inf), (None, -math.inf), (two, two), (None, two), (None, None)]
    assert repr([tuple(None if x is None else round(x, 9) if math.isfinite(x) else x for x in g[1:]) for g in got]) == repr([tuple(None if x is None else round(x, 9) if math.isfinite(x) else x for x in w) for w in want])


def test_features_may_be_there_without_being_finite(spark):
    from pyspark.sql import functions as F

    from barflow.operators import ml
    from barflow.plans import queries as q

    rows = q.with_signals(spark, "/root/testdata/sf0.01").persist()
    whole = ml.feature_matrix(rows, q.CFG).count()
    odd = rows.withColumn("htf_ret_5", F.lit(float("nan")))
    assert whole > 0 and ml.feature_matrix(odd, q.CFG).count() == 0 and ml.feature_matrix(odd, q.CFG, finite=False).count() == whole
    assert ml.feature_matrix(rows.withColumn("htf_ret_5", F.lit(None).cast("double")), q.CFG, finite=False).count() == 0
    rows.unpersist()

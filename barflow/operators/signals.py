"""Market regimes and rule-based signals for every bar at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import series
from .indicators import add_all_indicators, by, frame, with_htf

# Strategies that may trade in a regime, first preferred at equal conviction.
ELIGIBLE = {"trending": ["momentum", "breakout"], "ranging": ["mean_reversion"]}
_SIGNAL = "struct<side: string, strategy: string, entry: double, stop: double, take_profit: double, conviction: double>"


def regime(cfg: dict = DEFAULTS) -> Column:
    """volatile, trending, ranging or unknown; volatility wins, limits are strict, missing values are unknown."""
    c = cfg["regime"]
    known = F.col("adx").isNotNull() & F.col("atr_pct").isNotNull()
    return F.when(~known, "unknown").when(F.col("atr_pct") > c["atr_high_vol_pct"], "volatile").when(F.col("adx") > c["adx_trend"], "trending").when(F.col("adx") < c["adx_range"], "ranging").otherwise("unknown")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def _signal(side: str, strategy: str, stop: Column, target: Column, conviction: Column) -> Column:
    return F.struct(F.lit(side).alias("side"), F.lit(strategy).alias("strategy"), F.col("close").alias("entry"), stop.alias("stop"), target.alias("take_profit"), clamp(conviction, 0.1, 1.0).alias("conviction"))


def _ready() -> Column:
    return F.col("atr").isNotNull() & (F.col("atr") > 0)


def _named(names: dict[str, str] | None, *columns: str) -> list[Column]:
    """Columns under the names that a variant of the settings has for them."""
    return [F.col((names or {}).get(c, c)) for c in columns]


def momentum(cfg: dict = DEFAULTS, names: dict[str, str] | None = None) -> Column:
    """A cross of the averages with strength, volume and the longer trend behind it."""
    c = cfg["momentum"]
    close, atr, surge = F.col("close"), F.col("atr"), F.col("vol_surge")
    fast, slow, strength = _named(names, "ema_fast", "ema_slow", "rsi")
    f0, s0 = F.lag(fast).over(by()), F.lag(slow).over(by())
    enough = (F.col("n") >= max(c["ema_slow"], c["rsi_period"], 20) + 2) & (F.col("htf_rows") >= c["htf_ema"] + 1) & _ready() & (surge >= c["volume_mult"])
    conviction = 0.5 * F.least(F.abs(strength - 50.0) / 30.0, F.lit(1.0)) + 0.5 * clamp((surge - c["volume_mult"]) / c["volume_mult"], 0.0, 1.0)
    out = None
    for side, sign, cross, strong, trend in (("long", 1.0, (f0 <= s0) & (fast > slow), strength > c["rsi_min_long"], F.col("htf_close") > F.col("htf_ema")), ("short", -1.0, (f0 >= s0) & (fast < slow), strength < c["rsi_max_short"], F.col("htf_close") < F.col("htf_ema"))):
        stop = close - sign * c["stop_atr"] * atr
        made = _signal(side, "momentum", stop, close + sign * c["reward"] * F.abs(close - stop), conviction)
        out = F.when(enough & cross & strong & trend, made) if out is None else out.when(enough & cross & strong & trend, made)
    return out


def mean_reversion(cfg: dict = DEFAULTS, names: dict[str, str] | None = None) -> Column:
    """A close beyond a band with an extreme oscillator, back to the middle."""
    c = cfg["mean_reversion"]
    close, atr, (r,) = F.col("close"), F.col("atr"), _named(names, "rsi")
    enough = (F.col("n") >= max(c["bb_period"], c["rsi_period"]) + 5) & F.col("bb_mid").isNotNull() & _ready()
    if c["squeeze_on"]:
        enough = enough & (F.min("bb_width").over(frame(5)) <= c["squeeze_pct"])
    out = None
    for side, sign, beyond, extreme, depth, reach in (
        ("long", 1.0, close <= F.col("bb_lower"), r < c["oversold"], (c["oversold"] - r) / c["oversold"], (F.col("bb_lower") - close) / F.nullif(atr, F.lit(0.0))),
        ("short", -1.0, close >= F.col("bb_upper"), r > c["overbought"], (r - c["overbought"]) / (100.0 - c["overbought"]), (close - F.col("bb_upper")) / F.nullif(atr, F.lit(0.0))),
    ):
        stop = close - sign * c["stop_atr"] * atr
        target = F.when(sign * (F.col("bb_mid") - close) > 0, F.col("bb_mid")).otherwise(close + sign * c["fallback_r"] * F.abs(close - stop))
        made = _signal(side, "mean_reversion", stop, target, 0.5 * clamp(depth, 0.0, 1.0) + 0.5 * clamp(reach, 0.0, 1.0))
        out = F.when(enough & beyond & extreme, made) if out is None else out.when(enough & beyond & extreme, made)
    return out


def breakout(cfg: dict = DEFAULTS, names: dict[str, str] | None = None) -> Column:
    """A close beyond the range of quiet bars on volume, along the longer trend."""
    c = cfg["breakout"]
    close, atr, surge = F.col("close"), F.col("atr"), F.col("vol_surge")
    res, sup = _named(names, "resistance", "support")
    quiet = F.avg("atr_pct").over(frame(c["lookback"])) <= 2.0 * c["consolidation_pct"]
    enough = (F.col("n") >= c["lookback"] + 5) & quiet & _ready() & (surge >= c["volume_mult"])
    out = None
    for side, sign, beyond, trend, stop in (
        ("long", 1.0, close > res, F.col("htf_close") > F.col("htf_ema"), F.least(res - c["pad_atr"] * atr, close - c["stop_atr"] * atr)),
        ("short", -1.0, close < sup, F.col("htf_close") < F.col("htf_ema"), F.greatest(sup + c["pad_atr"] * atr, close + c["stop_atr"] * atr)),
    ):
        reach = sign * (close - (res if sign > 0 else sup)) / F.nullif(atr, F.lit(0.0))
        made = _signal(side, "breakout", stop, close + sign * c["reward"] * F.abs(close - stop), 0.6 * clamp(reach, 0.0, 1.0) + 0.4 * clamp((surge - c["volume_mult"]) / c["volume_mult"], 0.0, 1.0))
        out = F.when(enough & beyond & trend, made) if out is None else out.when(enough & beyond & trend, made)
    return out


def enrich(ltf: DataFrame, htf: DataFrame, cfg: dict = DEFAULTS, **more: Sequence[int]) -> DataFrame:
    """Bars with indicators (more: further periods of them), the longer bar as of each, the bar's number n (from 1) and the regime."""
    out = with_htf(add_all_indicators(ltf, cfg, **more), htf, cfg["momentum"]["htf_ema"])
    with series.over(out):
        return out.withColumns({"n": series.number(out).cast("int"), "regime": regime(cfg)})


#: Bars that a strategy may look back, windows and lags together.
REACH = 100

#: Strategies by name: each makes a signal column (NULL where it has none) from settings and, if a variant of them has its own, names of columns.
STRATEGIES: dict[str, Callable[..., Column]] = {"momentum": momentum, "mean_reversion": mean_reversion, "breakout": breakout}


def register(name: str, make: Callable[..., Column], regimes: Sequence[str]) -> None:
    """Add a strategy: make(cfg, names) returns its signal column; it may trade in the regimes named, after those already there."""
    STRATEGIES[name] = make
    for r in regimes:
        ELIGIBLE.setdefault(r, []).append(name)


def select_signal(made: dict[str, Column], cfg: dict = DEFAULTS, market: Column | None = None) -> Column:
    """The signal of most conviction among the strategies (by name) that may trade in the bar's regime."""
    market = F.col("regime") if market is None else market
    chosen = F.lit(None).cast(_SIGNAL)
    for name, strategies in ELIGIBLE.items():
        best = None
        for s in [s for s in strategies if s in cfg["enabled"] and s in made]:
            best = made[s] if best is None else F.when(best.isNull() | (made[s]["conviction"] > best["conviction"]), F.coalesce(made[s], best)).otherwise(best)
        if best is not None:
            chosen = F.when(market == name, best).otherwise(chosen)
    return chosen


def with_signals(enriched: DataFrame, cfg: dict = DEFAULTS) -> DataFrame:
    """Each bar with the signal of every strategy and the selected one (NULL if there is none).

    Strategies look back REACH bars at most, or the settings' longest lookback.
    """
    rows = series.haloed(enriched, max(REACH, *[v for part in cfg.values() if isinstance(part, dict) for k, v in part.items() if k == "lookback"]))
    with series.over(rows):
        out = series.own(rows.withColumns({name: make(cfg) for name, make in STRATEGIES.items()}))
    return out.withColumn("signal", select_signal({name: F.col(name) for name in STRATEGIES}, cfg))


def reward_risk(entry: Column, stop: Column, target: Column) -> Column:
    risk = F.abs(entry - stop)
    return F.when(risk > 0, F.abs(target - entry) / F.nullif(risk, F.lit(0.0))).otherwise(0.0)


def blackout(signals: DataFrame, events: DataFrame, currencies: DataFrame, minutes: int = 15) -> DataFrame:
    """The signals with the first high-impact event within so many minutes of their symbol's currencies, or NULL.

    events and currencies (symbol, currencies) are small dimensions; the time
    range becomes an equi-join on minute-wide bins around each event.
    """
    width = minutes * 60
    e = events.filter("impact = 'high'").withColumn("_order", F.monotonically_increasing_id())
    e = e.join(currencies.select("symbol", F.explode("currencies").alias("currency")).distinct(), "currency").withColumn("_t", F.unix_timestamp(F.col("time").cast("timestamp")))
    e = e.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("_t") - width) / max(width, 1)), F.floor((F.col("_t") + width) / max(width, 1))))).select("symbol", "_bin", "_t", "_order", F.col("name").alias("event"))
    s = signals.withColumn("_s", F.unix_timestamp(F.col("ts").cast("timestamp"))).withColumn("_bin", F.floor(F.col("_s") / max(width, 1)))
    hits = s.join(e, ["symbol", "_bin"]).filter(F.abs(F.col("_s") - F.col("_t")) <= width)
    first = hits.groupBy("symbol", "ts").agg(F.min_by("event", "_order").alias("blackout"))
    return signals.join(first, ["symbol", "ts"], "left")

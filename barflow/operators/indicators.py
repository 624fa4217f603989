"""Technical indicators over (symbol, ts), NULL until their frame is full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import series
from ..functions.ewm import ema, ewm, wilder


def by():  # noqa: ANN201
    """Bars of a symbol, or of its block inside `series.over`, in time order."""
    return Window.partitionBy(*series.current()).orderBy("ts")


def frame(n: int, last: int = 0):  # noqa: ANN201
    """The n rows that end `last` rows before the current one."""
    return by().rowsBetween(-(n - 1) - last, -last)


def full(value: Column, counted: str | Column, n: int, last: int = 0) -> Column:
    """A window value only where its frame holds n values."""
    return F.when(F.count(counted).over(frame(n, last)) == n, value)


def sma(x: str, n: int) -> Column:
    return full(F.avg(x).over(frame(n)), x, n)


def true_range() -> Column:
    before = F.lag("close").over(by())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def bollinger(x: str = "close", n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = sma(x, n), full(F.stddev_pop(x).over(frame(n)), x, n)
    return {"bb_mid": mid, "bb_upper": mid + sd * k, "bb_lower": mid - sd * k, "bb_width": ((mid + sd * k) - (mid - sd * k)) / F.nullif(mid, F.lit(0.0))}


def volume_surge(n: int = 20) -> Column:
    return F.col("volume") / F.nullif(sma("volume", n), F.lit(0.0))


def support_resistance(n: int = 20) -> dict[str, Column]:
    """Lowest low and highest high of the n bars before the current one."""
    return {"support": full(F.min("low").over(frame(n, 1)), "low", n, 1), "resistance": full(F.max("high").over(frame(n, 1)), "high", n, 1)}


def directional(df: DataFrame) -> DataFrame:
    """tr, gain and loss (of the close, NULL at the first bar), plus_dm and minus_dm (directional moves, 0 there)."""
    rows = series.haloed(df, 1)
    with series.over(rows):
        return series.own(rows.withColumns(_moves()))


def _moves() -> dict[str, Column]:
    change = F.col("close") - F.lag("close").over(by())
    rise, fall = F.col("high") - F.lag("high").over(by()), F.lag("low").over(by()) - F.col("low")
    return {
        "tr": true_range(), "gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))),
        "plus_dm": F.when((rise > fall) & (rise > 0), rise).otherwise(0.0), "minus_dm": F.when((fall > rise) & (fall > 0), fall).otherwise(0.0),
    }


def rsi_of(up: Column, down: Column) -> Column:
    """50 where there is no average loss."""
    return F.coalesce(100.0 - 100.0 / (1.0 + up / F.nullif(down, F.lit(0.0))), F.lit(50.0))


def dx_of(tr: Column, plus: Column, minus: Column) -> Column:
    p, m = 100.0 * plus / F.nullif(tr, F.lit(0.0)), 100.0 * minus / F.nullif(tr, F.lit(0.0))
    return 100.0 * F.abs(p - m) / F.nullif(p + m, F.lit(0.0))


def rsi(df: DataFrame, n: int = 14, name: str = "rsi") -> DataFrame:
    out = ewm(directional(df), [wilder("gain", n, "avg_gain"), wilder("loss", n, "avg_loss")])
    return out.withColumn(name, rsi_of(F.col("avg_gain"), F.col("avg_loss"))).select(*df.columns, name)


def atr(df: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return ewm(directional(df), [wilder("tr", n, name)]).select(*df.columns, name)


def adx(df: DataFrame, n: int = 14, name: str = "adx") -> DataFrame:
    out = ewm(directional(df), [wilder("tr", n, "atr_w"), wilder("plus_dm", n, "plus_w"), wilder("minus_dm", n, "minus_w")])
    out = out.withColumn("dx", dx_of(F.col("atr_w"), F.col("plus_w"), F.col("minus_w")))
    return ewm(out, [wilder("dx", n, name)]).select(*df.columns, name)


def add_all_indicators(df: DataFrame, cfg: dict = DEFAULTS, emas: Sequence[int] = (), rsis: Sequence[int] = (), ranges: Sequence[int] = ()) -> DataFrame:
    """The bars with all thirteen indicator columns, in two scans of averages; of blocked bars (functions.series) block by block.

    Further periods add ema_<n>, rsi_<n>, support_<n> and resistance_<n> to the same scans.
    """
    m, r, b, x = cfg["momentum"], cfg["mean_reversion"], cfg["breakout"], cfg["regime"]
    gains = {"": m["rsi_period"], **{f"_{n}": n for n in rsis}}
    first = [
        ema("close", m["ema_fast"], "ema_fast"), ema("close", m["ema_slow"], "ema_slow"), wilder("tr", x["atr_period"], "atr"), wilder("tr", x["adx_period"], "tr_w"), wilder("plus_dm", x["adx_period"], "plus_w"), wilder("minus_dm", x["adx_period"], "minus_w"),
        *[ema("close", n, f"ema_{n}") for n in emas], *[wilder(side, n, f"avg_{side}{k}") for k, n in gains.items() for side in ("gain", "loss")],
    ]
    spans = {f"{name}_{n}": (n, k) for n in ranges for k, name in enumerate(("support", "resistance"))}
    rows = series.haloed(df, max(r["bb_period"], b["lookback"], 20, *ranges))
    with series.over(rows):
        levels = {n: list(support_resistance(n).values()) for n in ranges}
        rows = rows.withColumns({**_moves(), **bollinger("close", r["bb_period"], r["bb_std"]), **support_resistance(b["lookback"]), **{name: levels[n][k] for name, (n, k) in spans.items()}, "vol_surge": volume_surge(20)})
    out = ewm(series.own(rows), first).withColumns({**{f"rsi{k}": rsi_of(F.col(f"avg_gain{k}"), F.col(f"avg_loss{k}")) for k in gains}, "dx": dx_of(F.col("tr_w"), F.col("plus_w"), F.col("minus_w"))})
    out = ewm(out, [wilder("dx", x["adx_period"], "adx")]).withColumn("atr_pct", 100.0 * F.col("atr") / F.nullif("close", F.lit(0.0)))
    return out.drop("tr", "gain", "loss", "plus_dm", "minus_dm", *[f"avg_{side}{k}" for k in gains for side in ("gain", "loss")], "tr_w", "plus_w", "minus_w", "dx")


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b): NULL if one is missing or b is 0; of a ratio below 0 NaN, of 0 minus infinity, so that no sum over it passes for a return."""
    ratio = a / F.nullif(b, F.lit(0.0))
    return F.when(ratio < 0, F.lit(float("nan"))).when(ratio == 0, F.lit(float("-inf"))).otherwise(F.ln(ratio))


def with_htf(ltf: DataFrame, htf: DataFrame, period: int = 50) -> DataFrame:
    """Each bar with the last longer bar labelled at or before it: close, average, its number, and feature inputs."""
    from .asof import asof_backward

    h = series.haloed(ewm(htf.select("symbol", "ts", "close", *[c for c in htf.columns if c in series.PLACE]), [ema("close", period, "htf_ema")]), 5)
    with series.over(h):
        h = series.own(h.withColumns({"htf_rows": series.number(h).cast("int"), "htf_ret_5": log_ratio(F.col("close"), F.lag("close", 5).over(by())), "htf_slope_sign": F.coalesce(F.signum(F.col("htf_ema") - F.lag("htf_ema", 5).over(by())), F.lit(0.0))}))
    h = h.select("symbol", "ts", F.col("close").alias("htf_close"), "htf_ema", "htf_rows", "htf_ret_5", "htf_slope_sign")
    counted = series.is_blocked(ltf) or series.is_blocked(htf)
    return asof_backward(ltf, h, "symbol", "ts", series.BLOCK_ROWS if counted else None)

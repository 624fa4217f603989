"""Dashboard and alert queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import fixed
from ..sources.bars import latest


def account_header(equity: DataFrame) -> DataFrame:
    """Equity, peak, drawdown, day and week result of the newest point of a curve (ts, equity)."""
    last = equity.agg(F.max_by("equity", "ts").alias("equity"), F.max("equity").alias("peak"), F.max("ts").alias("ts"))
    day = equity.withColumn("d", F.to_date("ts")).groupBy("d").agg(F.min_by("equity", "ts").alias("day_start"))
    week = equity.withColumn("w", F.date_trunc("week", "ts")).groupBy("w").agg(F.min_by("equity", "ts").alias("week_start"))
    out = last.join(day, F.to_date("ts") == F.col("d")).join(week, F.date_trunc("week", "ts") == F.col("w"))
    return out.select("equity", "peak", ((F.col("peak") - F.col("equity")) / F.nullif("peak", F.lit(0.0))).alias("drawdown"), (F.col("equity") - F.col("day_start")).alias("day_pnl"), (F.col("equity") - F.col("week_start")).alias("week_pnl"))


def open_positions(positions: DataFrame, marks: DataFrame) -> DataFrame:
    from .risk import r_multiple, unrealized

    out = positions.join(marks.select("symbol", F.col("close").alias("mark")), "symbol")
    return out.withColumns({"unrealized": unrealized(F.col("mark")), "r": r_multiple(F.col("mark"))})


def latest_signals(signals: DataFrame) -> DataFrame:
    return latest(signals).orderBy("symbol")


def recent_trades(trades: DataFrame, n: int = 10) -> DataFrame:
    return trades.orderBy(F.desc("exit_time"), F.desc("seq")).limit(n)


def day_summary(trades: DataFrame, start: float = 100_000.0) -> DataFrame:
    out = trades.groupBy(F.to_date("exit_time").alias("day")).agg(F.sum("pnl").alias("day_pnl"), F.count("*").alias("trades"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return out.withColumn("day_pct", F.col("day_pnl") / start)


def stats(trades: DataFrame, start: float = 100_000.0) -> DataFrame:
    """Equity and counts; a trade that is not won counts as lost; money is rounded half to even."""
    return trades.agg(F.bround(start + F.sum("pnl"), 2).alias("equity"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") <= 0).alias("losses"), F.bround(F.sum("pnl"), 2).alias("realised"))


def halt_edges(marks: DataFrame, limit: float = 0.04, *key: str) -> DataFrame:
    """Times at which a day's loss from its first equity first reaches the limit, of one curve or of each key's."""
    day = Window.partitionBy(*key, F.to_date("ts")).orderBy("ts")
    halted = marks.withColumn("loss", 1 - F.col("equity") / F.first("equity").over(day)).withColumn("halted", F.max((F.col("loss") >= limit).cast("int")).over(day.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return halted.withColumn("before", F.coalesce(F.lag("halted").over(day), F.lit(False))).filter("halted AND NOT before").select(*key, "ts", "equity", "loss")


def entry_text() -> Column:
    return F.format_string("ENTRY %s %s %s @ %s stop %s target %s", F.upper("side"), F.col("symbol"), F.col("strategy"), fixed("entry", 4), fixed("stop", 4), fixed("take_profit", 4))


def exit_text() -> Column:
    return F.format_string("EXIT %s %s %s pnl %s (%sR)", F.upper("side"), F.col("symbol"), F.col("exit_reason"), fixed("pnl", 2), fixed("r_multiple", 2))


def alerts(trades: DataFrame, enabled: list[str]) -> DataFrame:
    rows = trades.select(F.lit("EXIT").alias("type"), F.col("exit_time").alias("ts"), F.concat_ws(" ", F.lit("exit"), "symbol").alias("title"), exit_text().alias("body"))
    return rows.filter(F.col("type").isin(*enabled))


def _alert(kind: str, ts: Column, title: Column, body: Column) -> list[Column]:
    return [F.lit(kind).alias("type"), ts.alias("ts"), title.alias("title"), body.alias("body")]


# Titles and bodies of the alerts.
def entry_alerts(entries: DataFrame) -> DataFrame:
    """entries: symbol, side, qty, entry, stop, take_profit, strategy, conviction, ts."""
    rr = F.abs(F.col("take_profit") - F.col("entry")) / F.greatest(F.abs(F.col("entry") - F.col("stop")), F.lit(1e-9))
    body = F.format_string("`%s` %s qty=%s\nEntry: %s  Stop: %s  Target: %s\nStrategy: %s  Conviction: %s\nR:R = %s", "symbol", "side", fixed("qty", 4), fixed("entry", 4), fixed("stop", 4), fixed("take_profit", 4), "strategy", fixed("conviction", 2), fixed(rr, 2))
    return entries.select(*_alert("ENTRY", F.col("ts"), F.format_string("%s %s entry", "symbol", "side"), body))


def exit_alerts(trades: DataFrame) -> DataFrame:
    body = F.format_string("`%s` %s\nEntry: %s  Exit: %s\nP&L: $%s  R: %s\nStrategy: %s  Reason: %s", F.col("symbol"), F.upper("side"), fixed("entry_price", 4), fixed("exit_price", 4), fixed("pnl", 2), fixed("r_multiple", 2), F.col("strategy"), F.col("exit_reason"))
    return trades.select(*_alert("EXIT", F.col("exit_time"), F.format_string("%s exit (%s)", "symbol", "exit_reason"), body))


def halt_alerts(halts: DataFrame) -> DataFrame:
    """halts: ts, reason, equity, drawdown."""
    return halts.select(*_alert("HALT", F.col("ts"), F.lit("Trading halted"), F.format_string("Reason: %s\nEquity: $%s\nDrawdown: %s%%", F.col("reason"), fixed("equity", 2, grouped=True), fixed(F.col("drawdown") * 100, 2))))


def message_alerts(messages: DataFrame, kind: str = "INFO") -> DataFrame:
    """messages: ts, body, and title for INFO; an ERROR has the title `Error`."""
    return messages.select(*_alert(kind, F.col("ts"), F.lit("Error") if kind == "ERROR" else F.col("title"), F.col("body")))


def summary_alerts(days: DataFrame) -> DataFrame:
    """days: ts, equity, day_pnl, day_pct, trades, win_rate, open_positions."""
    body = F.format_string("Equity: $%s\nDay P&L: $%s (%s%%)\nTrades today: %d  Win rate: %s%%\nOpen positions: %d", fixed("equity", 2, grouped=True), fixed("day_pnl", 2, grouped=True, signed=True), fixed(F.col("day_pct") * 100, 2, signed=True), F.col("trades"), fixed(F.col("win_rate") * 100, 1), F.col("open_positions"))
    return days.select(*_alert("SUMMARY", F.col("ts"), F.lit("Daily summary"), body))


def daily_summary_due(ticks: DataFrame, hour: int) -> DataFrame:
    """The first time of each day at or after the hour."""
    return ticks.filter(F.hour("ts") >= hour).groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("due"))

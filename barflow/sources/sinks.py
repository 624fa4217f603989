"""File sinks and fan-out of alerts."""

from __future__ import annotations

import logging
import urllib.request
from collections.abc import Callable, Iterable
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ledger import Ledger, message_key, once

TRADE_COLUMNS = ["symbol", "side", "strategy", "entry_time", "exit_time", "entry_price", "exit_price", "qty", "pnl", "r_multiple", "exit_reason"]
log = logging.getLogger("barflow")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_trades(trades: DataFrame, path: str) -> bool:
    """The eleven trade columns as CSV; nothing is written without trades."""
    if trades.isEmpty():
        return False
    write_csv(trades.select(*TRADE_COLUMNS), path)
    return True


def fill_log(fills: DataFrame) -> DataFrame:
    """Fills in the log's thirteen columns and number formats; an unknown price or time is empty."""
    number = lambda c, form: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(form, c)), F.lit("")).alias(c)
    price = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.format_string("%.8f", c)).otherwise("").alias(c)
    time = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")).alias(c)
    return fills.select(time("submit_ts"), time("fill_ts"), "symbol", "side", "strategy", number("qty", "%.8f"), price("intended_price"), price("fill_price"), number("slippage_bps", "%.2f"), "order_type", "status", "broker", number("latency_ms", "%.0f"))


def write_equity(equity: DataFrame, path: str) -> None:
    """The equity curve (ts, equity) as CSV with the columns timestamp and equity."""
    write_csv(equity.select(F.col("ts").alias("timestamp"), "equity"), path)


WALK_COLUMNS = ["window", "test_start", "test_end"]
SENSITIVITY_COLUMNS = ["n_trades", "sharpe", "sortino", "profit_factor", "max_dd_pct", "win_rate", "expectancy_R", "total_return_pct", "final_equity"]


def write_walkforward(results: DataFrame, windows: DataFrame, path: str) -> None:
    """Metrics of each window (run_id is its number), with the window and its test dates behind them, as CSV."""
    out = results.join(windows.select(F.col("window").cast("string").alias("run_id"), *WALK_COLUMNS), "run_id")
    write_csv(out.select(*[c for c in results.columns if c != "run_id"], *WALK_COLUMNS), path)


def write_sensitivity(results: DataFrame, keys: list[str], path: str) -> None:
    """Parameters, metrics and, where a combination failed, its error (the column is left out if none did), as CSV."""
    out = results.withColumnRenamed("expectancy_r", "expectancy_R")
    failed = "error" in out.columns and not out.filter("error IS NOT NULL").isEmpty()
    write_csv(out.select(*keys, *SENSITIVITY_COLUMNS, *(["error"] if failed else [])), path)


def append_fills(fills: DataFrame, path: str) -> None:
    """Append to a log that no stream writes; a stream's batches go through fill_batches."""
    fill_log(fills).write.mode("append").option("header", True).csv(path)


def fill_batches(ledger: Ledger) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that logs each batch of fills once, under the ledger's folder."""
    return once(ledger, lambda batch, path: fill_log(batch).write.option("header", True).csv(path))


def read_fills(ledger: Ledger) -> DataFrame:
    """The committed fill log: its thirteen columns as text, and the batch."""
    return ledger.spark.read.option("header", True).csv(ledger.root)


def console(alert: dict) -> None:
    print(f"[{alert['ts']}] {alert['type']}: {alert['title']} {alert['body']}")


def webhook(url: str, timeout: float = 10.0) -> Callable[[dict], None]:
    """A channel that posts alerts to a chat webhook of the caller's."""

    def send(alert: dict) -> None:
        import json

        request = urllib.request.Request(url, json.dumps({"text": f"{alert['title']}\n{alert['body']}"}).encode(), {"Content-Type": "application/json"})
        urllib.request.urlopen(request, timeout=timeout).close()

    return send


def fan_out(channels: Iterable[Callable[[dict], None]], enabled: set[str] | None = None, ledger: Ledger | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends enabled alerts to every channel; a failing channel is logged and skipped.

    With a ledger an alert goes to a channel once, however often its batch
    runs: it is entered before it is sent.
    """
    channels = list(channels)

    def send(batch: DataFrame, number: int) -> None:
        rows = batch if enabled is None else batch.filter(F.col("type").isin(*enabled))
        seen: list[dict[str, int]] = [{} for _ in channels]
        for row in rows.toLocalIterator():
            for k, channel in enumerate(channels):
                if ledger is not None and not ledger.enter(message_key(number, k, row.asDict(), seen[k])):
                    continue
                try:
                    channel(row.asDict())
                except Exception:  # a lost alert must not stop the stream
                    log.exception("alert channel failed")

    return send


def setup_logging(path: str, level: str = "INFO", size: int = 10 << 20, copies: int = 5) -> logging.Logger:
    handler = RotatingFileHandler(path, maxBytes=size, backupCount=copies)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(level)
    return log

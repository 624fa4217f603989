"""Backtests: one ordered fold a run over bars that already carry their signals.

Runs (parameter sets, date windows) are rows of one DataFrame keyed by run_id,
so walk-forward windows and grids are parallel groups of one job.
"""

from __future__ import annotations

import copy
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, expand_grid, faults, set_path
from ..schema import EVENT
from ..sources.bars import small
from .fold import Bar, Simulator, event_frame
from .signals import STRATEGIES, enrich, regime, select_signal, with_signals


def fold_rows(rows: DataFrame, asset_class: str, *more: Column) -> DataFrame:
    by = Window.partitionBy("symbol").orderBy("ts")
    return rows.select(
        "symbol", F.lit(asset_class).alias("asset_class"), (F.col("n") - 1).alias("k"), F.count("*").over(Window.partitionBy("symbol")).alias("n"), "ts", "open", "high", "low", "close",
        F.lead("open").over(by).alias("next_open"), F.coalesce("htf_rows", F.lit(0)).alias("htf_rows"), *more,
    )


def prepared(ltf: DataFrame, htf: DataFrame, cfg: dict = DEFAULTS, run_id: str = "run", asset_class: str = "crypto") -> DataFrame:
    """Rows of the fold: every bar with its place, next open, count of longer bars and selected signal."""
    return fold_rows(with_signals(enrich(ltf, htf, cfg), cfg), asset_class, F.lit(run_id).alias("run_id"), F.col("regime"), F.col("signal"))


def simulate(rows: DataFrame, cfg: dict = DEFAULTS, portfolio: bool = False, fill_mode: str = "parity", runs: dict[str, dict] | None = None, catch: bool = False) -> DataFrame:
    """Events (trades, equity, rejects) of every run; a portfolio folds all symbols of a run together.

    runs: settings of the runs that have their own, by run_id.  catch: a run
    that fails gives one row of kind `error` with the reason, and no others.
    """

    def events(pdf) -> list[dict]:  # noqa: ANN001
        pdf = pdf.sort_values(["ts", "symbol"], kind="stable")
        sim = Simulator((runs or {}).get(pdf["run_id"].iloc[0], cfg), fill_mode)
        short = {s for s, n in zip(pdf["symbol"], pdf["n"], strict=True) if n < sim.cfg["backtest"]["warmup"] + 10}
        signal = pdf["signal"].tolist()
        times = [x.to_pydatetime() for x in pdf["ts"]]
        for j, r in enumerate(pdf[["symbol", "asset_class", "k", "n", "open", "high", "low", "close", "next_open", "htf_rows"]].itertuples(index=False)):
            if r.symbol in short:
                continue
            x = signal[j]
            x = None if x is None else (x["side"], x["strategy"], x["entry"], x["stop"], x["take_profit"], x["conviction"])
            sim.step(Bar(r.symbol, r.asset_class, int(r.k), int(r.n), times[j], r.open, r.high, r.low, r.close, r.next_open, int(r.htf_rows), x))
        return sim.events

    def one(pdf):  # noqa: ANN001, ANN202
        try:
            found = events(pdf)
        except Exception as e:
            if not catch:
                raise
            found = [{"kind": "error", "reason": str(e)}]
        return event_frame(found, pdf["run_id"].iloc[0], EVENT)

    keys = ["run_id"] if portfolio else ["run_id", "symbol"]
    return rows.groupBy(*keys).applyInPandas(one, EVENT)


def trades_of(events: DataFrame) -> DataFrame:
    e = events.filter("kind = 'trade'")
    return e.select("run_id", "symbol", "side", "strategy", "entry_time", F.col("ts").alias("exit_time"), "entry_price", "exit_price", "qty", "pnl", "pnl_pct", "r_multiple", F.col("reason").alias("exit_reason"), "fees", "seq")


def equity_of(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'equity'").select("run_id", "symbol", "ts", "equity")


def run_windows(ltf: DataFrame, htf: DataFrame, windows: list[dict], cfg: dict = DEFAULTS) -> DataFrame:
    """Fold rows of every test window, in one plan: a bar on a border belongs to both windows, and indicators start afresh in each.

    A window's bars are a series of their own, named by window and symbol, so
    every window function is partitioned by both.
    """
    frame = ltf.sparkSession.createDataFrame([(str(w["window"]), str(w["test_start"]), str(w["test_end"])) for w in windows], "w string, a string, b string").select("w", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    # a row a day of each window, so that bars meet windows by equal days
    days = small(frame.filter("a <= b").withColumn("_day", F.explode(F.sequence(F.to_date("a"), F.to_date("b")))))

    def inside(bars: DataFrame) -> DataFrame:
        met = bars.withColumn("_day", F.to_date("ts")).join(days, "_day").filter((F.col("ts") >= F.col("a")) & (F.col("ts") <= F.col("b")))
        return met.select(F.concat_ws("|", "w", "symbol").alias("symbol"), *[c for c in bars.columns if c != "symbol"])

    rows = prepared(inside(ltf), inside(htf), cfg)
    return rows.withColumns({"run_id": F.substring_index("symbol", "|", 1), "symbol": F.expr("substring(symbol, instr(symbol, '|') + 1)")})


def run_grid(ltf: DataFrame, htf: DataFrame, grid: dict[str, list], cfg: dict = DEFAULTS, asset_class: str = "crypto") -> tuple[DataFrame | None, dict[str, dict], list[tuple[str, dict, str | None]]]:
    """Fold rows of every combination, settings by run_id (its index), and run_id, combination and fault of each.

    Averages, oscillators and ranges of all periods come from one pass over the
    bars; a combination is a further signal column, and a bar is exploded to one
    row a combination.  Only settings of bands, regimes and the longer average
    make a pass of their own.  Combinations whose settings are at fault have no
    rows (None, if all are).
    """
    runs, settings, passes = [], {}, {}
    for k, combo in enumerate(expand_grid(grid)):
        c = copy.deepcopy(cfg)
        for path, v in combo.items():
            set_path(c, path, v)
        fault = faults(c)
        runs.append((str(k), combo, fault))
        if fault is None:
            settings[str(k)] = c
            own = [c["mean_reversion"][x] for x in ("bb_period", "bb_std")] + [c["regime"][x] for x in ("adx_period", "atr_period")] + [c["momentum"]["htf_ema"]]
            passes.setdefault(json.dumps(own), []).append(str(k))
    parts = [_variants(ltf, htf, {k: settings[k] for k in own}, asset_class) for own in passes.values()]
    return (reduce(DataFrame.unionByName, parts) if parts else None), settings, runs


def _variants(ltf: DataFrame, htf: DataFrame, settings: dict[str, dict], asset_class: str) -> DataFrame:
    """Fold rows of combinations that share bands, regimes' averages and the longer average."""
    periods = lambda *paths: sorted({c[a][b] for c in settings.values() for a, b in paths})
    rows = enrich(ltf, htf, next(iter(settings.values())), emas=periods(("momentum", "ema_fast"), ("momentum", "ema_slow")), rsis=periods(("momentum", "rsi_period")), ranges=periods(("breakout", "lookback")))
    columns, chosen = {}, []
    for run_id, c in settings.items():
        m, n = c["momentum"], c["breakout"]["lookback"]
        names = {"ema_fast": f"ema_{m['ema_fast']}", "ema_slow": f"ema_{m['ema_slow']}", "rsi": f"rsi_{m['rsi_period']}", "support": f"support_{n}", "resistance": f"resistance_{n}"}
        made = {}
        for name, make in STRATEGIES.items():
            column = columns.setdefault(json.dumps([name, names, c], sort_keys=True) if name not in c else json.dumps([name, c[name], [names[x] for x in _READS.get(name, names)]]), (f"_s{len(columns)}", make(c, names)))
            made[name] = F.col(column[0])
        chosen.append(F.struct(F.lit(run_id).alias("run_id"), regime(c).alias("regime"), select_signal(made, c, regime(c)).alias("signal")))
    # exploded afterwards, so that windows see each bar once
    rows = fold_rows(rows.withColumns(dict(columns.values())), asset_class, F.array(*chosen).alias("x"))
    return rows.withColumn("x", F.explode("x")).select("*", "x.*").drop("x")


#: Columns with a period in their name that a strategy reads.
_READS = {"momentum": ["ema_fast", "ema_slow", "rsi"], "mean_reversion": ["rsi"], "breakout": ["support", "resistance"]}


def grid_results(metrics: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """One row a combination: runs (run_id, parameters, error), its metrics, and the error of one that failed, with no metrics."""
    failed = events.filter("kind = 'error'").groupBy("run_id").agg(F.min("reason").alias("_failed"))
    out = runs.join(metrics, "run_id", "left").join(failed, "run_id", "left").withColumn("error", F.coalesce("error", "_failed")).drop("_failed")
    own = [c for c in metrics.columns if c != "run_id"]
    return out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in own})


def grid_frame(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """The grid as rows: one row exploded by each parameter's values."""
    rows = spark.range(1)
    for name, values in grid.items():
        rows = rows.withColumn(name.replace(".", "_"), F.explode(F.array(*[F.lit(v) for v in values])))
    return rows.drop("id")

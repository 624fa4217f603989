"""Performance of trades and equity curves, and their summaries over windows, grids and resamples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series
from ..functions.texts import fixed

YEAR = 252


def equity_curve(trades: DataFrame, start: float = 100_000.0, key: str = "run_id", rows: int = series.BLOCK_ROWS) -> DataFrame:
    """Steps of realised equity by exit time, seeded at the entry of the first trade to exit; a run of more trades than `rows` is summed in blocks."""
    order = ("exit_time", "seq")
    cut = series.blocked(trades, (key,), order, rows)
    summed = series.running(cut, {"_sum": ("sum", "pnl")}, (key,), order)
    step = F.col("_i") + 1 if series.is_blocked(cut) else F.row_number().over(Window.partitionBy(key).orderBy(*order))
    steps = summed.select(key, F.col("exit_time").alias("ts"), step.cast("long").alias("step"), (F.lit(start) + F.col("_sum")).alias("equity"))
    seed = trades.groupBy(key).agg(F.min_by("entry_time", F.struct("exit_time", "seq")).alias("ts")).select(key, "ts", F.lit(0).cast("long").alias("step"), F.lit(start).alias("equity"))
    return seed.unionByName(steps)


def daily_returns(curve: DataFrame, key: str = "run_id") -> DataFrame:
    """Last equity of every calendar day, carried over days without one, and its relative change."""
    days = curve.groupBy(key, F.to_date("ts").alias("day")).agg(F.max_by("equity", F.struct("ts", "step")).alias("equity"))
    spine = days.groupBy(key).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    order = Window.partitionBy(key).orderBy("day")
    filled = spine.join(days, [key, "day"], "left").withColumn("equity", F.last("equity", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("ret", F.col("equity") / F.nullif(F.lag("equity").over(order), F.lit(0.0)) - 1)


def sharpe(r: str = "ret") -> Column:
    return F.coalesce(F.sqrt(F.lit(float(YEAR))) * F.avg(r) / F.nullif(F.stddev_pop(r), F.lit(0.0)), F.lit(0.0))


def sortino(r: str = "ret") -> Column:
    """Over the deviation of the negative returns about their own mean."""
    return F.coalesce(F.sqrt(F.lit(float(YEAR))) * F.avg(r) / F.nullif(F.stddev_pop(F.when(F.col(r) < 0, F.col(r))), F.lit(0.0)), F.lit(0.0))


def profit_factor(pnl: str = "pnl") -> Column:
    won, lost = F.coalesce(F.sum(F.when(F.col(pnl) > 0, F.col(pnl))), F.lit(0.0)), F.coalesce(-F.sum(F.when(F.col(pnl) < 0, F.col(pnl))), F.lit(0.0))
    return F.when(lost > 0, won / F.nullif(lost, F.lit(0.0))).when(won > 0, F.lit(float("inf"))).otherwise(0.0)


def drawdown(curve: DataFrame, key: str = "run_id", order: str = "day", rows: int | None = None) -> DataFrame:
    """Largest relative and absolute fall below the running peak; rows: of a run, beyond which its peak is carried from block to block (None: never, uncounted)."""
    cut = curve if rows is None else series.blocked(curve, (key,), order, rows)
    d = series.running(cut, {"_p": ("max", "equity")}, (key,), order)
    return d.groupBy(key).agg(F.max((F.col("_p") - F.col("equity")) / F.nullif("_p", F.lit(0.0))).alias("max_dd_pct"), F.max(F.col("_p") - F.col("equity")).alias("max_dd_abs"))


def trade_metrics(trades: DataFrame, start: float = 100_000.0, key: str = "run_id") -> DataFrame:
    hours = (F.unix_timestamp(F.col("exit_time").cast("timestamp")) - F.unix_timestamp(F.col("entry_time").cast("timestamp"))) / 3600.0
    return trades.groupBy(key).agg(
        F.count("*").alias("n_trades"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), profit_factor().alias("profit_factor"), F.avg("r_multiple").alias("expectancy_r"),
        F.avg(hours).alias("avg_hours"), (F.sum("pnl") / start).alias("total_return_pct"), (start + F.sum("pnl")).alias("final_equity"),
    )


def compute_metrics(trades: DataFrame, start: float = 100_000.0, key: str = "run_id") -> DataFrame:
    """All metrics of each run that has trades."""
    daily = daily_returns(equity_curve(trades, start, key), key)
    ratios = daily.groupBy(key).agg(sharpe().alias("sharpe"), sortino().alias("sortino"))
    return trade_metrics(trades, start, key).join(ratios, key).join(drawdown(daily, key), key)


def with_empty_runs(metrics: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs without trades as rows of zeros; they have no final equity."""
    zero = {c: 0 for c in metrics.columns if c not in (key, "final_equity")}
    return runs.select(key).join(metrics, key, "left").fillna(zero)


def summary_text(m: Column | None = None) -> Column:
    return F.format_string("trades %d | return %s%% | win %s%% | PF %s | Sharpe %s | Sortino %s | max DD %s%%", F.col("n_trades"), fixed(F.col("total_return_pct") * 100, 2), fixed(F.col("win_rate") * 100, 1), fixed("profit_factor", 2), fixed("sharpe", 2), fixed("sortino", 2), fixed(F.col("max_dd_pct") * 100, 2))


def add_months(d: dt.datetime, n: int) -> dt.datetime:
    month = d.month - 1 + n
    year, month = d.year + month // 12, month % 12 + 1
    last = (dt.datetime(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return d.replace(year=year, month=month, day=min(d.day, last))


def make_windows(start: dt.datetime, end: dt.datetime, train_months: int = 6, test_months: int = 2, n: int = 4) -> list[dict]:
    """Rolling windows that advance by the test length, while the test ends by `end`."""
    out, at = [], start
    while len(out) < n:
        mid = add_months(at, train_months)
        stop = add_months(mid, test_months)
        if stop > end:
            break
        out.append({"window": len(out), "train_start": at, "train_end": mid, "test_start": mid, "test_end": stop})
        at = add_months(at, test_months)
    return out


def cover_windows(start: dt.datetime | None, end: dt.datetime | None, days: int = 8) -> list[dict]:
    """Test windows that cover start to end without a gap, as many of at least `days` as fit (one if none does), split at whole hours from start."""
    if start is None:
        return []
    n = max(1, (end - start) // dt.timedelta(days=days))
    hours = (end - start) // dt.timedelta(hours=1)
    edges = [start + dt.timedelta(hours=hours * k // n) for k in range(n)] + [end]
    return [{"window": k, "test_start": a, "test_end": b} for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def windows_frame(spark: SparkSession, start: str, end: str, train_months: int = 6, test_months: int = 2, n: int = 4) -> DataFrame:
    """The same windows as rows, months added step by step so that a clamped day stays clamped."""
    step = F.sequence(F.lit(1), F.lit(n))
    at = F.aggregate(F.slice(step, 1, n - 1), F.array(F.lit(start).cast("date")), lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), test_months))))
    rows = spark.range(1).select(F.posexplode(at).alias("window", "train_start"))
    rows = rows.withColumn("test_start", F.add_months("train_start", train_months)).withColumn("test_end", F.add_months("test_start", test_months))
    return rows.filter(F.col("test_end") <= F.lit(end).cast("date")).select("window", "train_start", F.col("test_start").alias("train_end"), "test_start", "test_end")


WALK_METRICS = ("sharpe", "sortino", "profit_factor", "max_dd_pct", "win_rate", "expectancy_r", "total_return_pct")


def walkforward_aggregate(results: DataFrame) -> DataFrame:
    """Mean, least and most of seven metrics over windows that traded, and counts."""
    traded = F.col("n_trades") > 0
    parts = [f(F.when(traded, F.col(m))).alias(f"{m}_{n}") for m in WALK_METRICS for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return results.agg(F.count("*").alias("windows"), F.count_if(traded).alias("windows_traded"), F.sum("n_trades").alias("total_trades"), *parts)


def sensitivity_summary(results: DataFrame) -> DataFrame:
    """Spread of the Sharpe ratio and of finite profit factors over combinations, and their stability."""
    pf = F.when(F.abs("profit_factor") < float("inf"), F.col("profit_factor"))
    return results.agg(F.count("*").alias("combos"), F.avg("sharpe").alias("sharpe_mean"), F.stddev_pop("sharpe").alias("sharpe_std"), F.min("sharpe").alias("sharpe_min"), F.max("sharpe").alias("sharpe_max"), F.avg(pf).alias("pf_mean"), F.stddev_pop(pf).alias("pf_std"), (F.avg("sharpe") / (F.stddev_pop("sharpe") + 1e-9)).alias("stability"))


def mc_returns(trades: DataFrame, start: float = 100_000.0, block: int = 1 << 16) -> DataFrame:
    """idx (place by seq, from 0) and r (pnl over starting equity) of every trade; seq is unique.

    Trades are counted in blocks of seq and numbered inside their block, so only
    the counts, one row a block, meet in one window.
    """
    rows = trades.select("seq", "pnl", F.floor(F.col("seq") / block).alias("block"))
    sizes = rows.groupBy("block").count()
    before = sizes.select("block", (F.sum("count").over(Window.orderBy("block")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("seq")) - 1
    return rows.withColumn("_n", place).join(before, "block").select((F.col("before") + F.col("_n")).alias("idx"), (F.col("pnl") / start).alias("r"))


def mc_draws(spark: SparkSession, n_runs: int, n_draws: int, n_trades: int, seed: int = 42) -> DataFrame:
    """run, k, idx: bootstrap draws with replacement, the same in every engine (md5 of seed, run and place)."""
    text = F.concat_ws(":", F.lit(seed).cast("string"), F.col("run").cast("string"), F.col("k").cast("string"))
    per = max(n_draws, 1)
    rows = spark.range(n_runs * n_draws).select(F.expr(f"id div {per}").alias("run"), (F.col("id") % per).alias("k"))
    return rows.withColumn("idx", F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % max(n_trades, 1))


#: Draws of a run that are folded as one block.
MC_BLOCK = 1 << 16


def mc_paths(draws: DataFrame, returns: DataFrame, start: float = 100_000.0, ruin: float = 0.5, block: int = MC_BLOCK) -> DataFrame:
    """run, final_equity, max_dd, ruined of additive paths.  returns: idx, r (pnl over starting equity).

    A path is summed in blocks of `block` draws: each is first a row of its sum
    and its greatest prefix, which give every block the equity and the peak
    that enter it; falls below the peak are then taken inside the blocks.
    """
    rows = draws.join(returns, "idx").select("run", "k", F.floor(F.col("k") / block).alias("_block"), (F.col("r") * start).alias("step"))
    order = Window.partitionBy("run", "_block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_sum", F.sum("step").over(order))
    blocks = inside.groupBy("run", "_block").agg(F.sum("step").alias("_total"), F.max("_sum").alias("_top"))
    before = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.lit(start) + F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("_peak", F.greatest(F.max(F.col("_base") + F.col("_top")).over(before), F.lit(start))).select("run", "_block", "_base", "_peak")
    path = inside.join(blocks, ["run", "_block"]).withColumn("equity", F.col("_base") + F.col("_sum"))
    path = path.withColumn("peak", F.greatest(F.max("equity").over(order), "_peak"))
    return path.groupBy("run").agg(F.max_by("equity", "k").alias("final_equity"), F.greatest(F.max((F.col("peak") - F.col("equity")) / F.col("peak")), F.lit(0.0)).alias("max_dd"), (F.least(F.min("equity"), F.lit(start)) <= ruin * start).alias("ruined"))


#: Trades up to which a task holds all returns (1 GB), so that runs are drawn and folded where they are numbered.
MC_HELD = 1 << 27


def mc_blocks(returns: DataFrame) -> DataFrame:
    """first and r: returns whose places follow one another as one row of packed doubles, an unknown one as 0."""

    def pack(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for b in batches:
            idx, r = b.column("idx").to_numpy(), b.column("r").fill_null(0.0).to_numpy()
            order = np.argsort(idx, kind="stable")
            idx, r = idx[order], r[order]
            edges = [0, *(np.flatnonzero(np.diff(idx) != 1) + 1).tolist(), len(idx)]
            spans = [(x, y) for x, y in zip(edges, edges[1:], strict=False) if x < y]
            yield pa.RecordBatch.from_arrays([pa.array([int(idx[x]) for x, _ in spans], pa.int64()), pa.array([r[x:y].tobytes() for x, y in spans], pa.binary())], names=["first", "r"])

    return returns.mapInArrow(pack, "first long, r binary")


def monte_carlo(trades: DataFrame, n_runs: int = 1000, seed: int = 42, start: float = 100_000.0, ruin: float = 0.5, sent: int = MC_HELD) -> DataFrame:
    """mc_paths of n_runs runs of as many draws as there are trades (seq, pnl).

    Runs are dealt to tasks, and the returns, packed, are shuffled to each of
    them once: no draw is shuffled, and a task holds the returns and one chunk
    of draws.  Beyond `sent` trades, counted first, draws meet returns in a join
    and windows fold them.  Both draw the same.
    """
    import numpy as np

    spark, n = trades.sparkSession, trades.count()
    returns = mc_returns(trades, start)
    if n > sent:
        return mc_paths(mc_draws(spark, n_runs, n, n, seed), returns, start, ruin)
    tasks = min(n_runs, 2 * spark.sparkContext.defaultParallelism)

    def fold(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        from ..functions.draws import draws

        r, task = None, None
        for b in batches:
            r = np.zeros(n) if r is None else r
            for task, first, packed in zip(b.column("task").to_pylist(), b.column("first").to_pylist(), b.column("r"), strict=True):
                part = np.frombuffer(packed.as_buffer(), np.float64)
                r[first : first + len(part)] = part * start
        for run in range(task, n_runs, tasks) if r is not None else ():
            total, peak, low, fall = 0.0, start, start, 0.0
            for k in range(0, n, MC_BLOCK):
                step = r[draws(f"{seed}:{run}:", k, min(k + MC_BLOCK, n), n)]
                step[0] += total
                np.cumsum(step, out=step)
                total = step[-1]
                equity = start + step
                peaks = np.maximum(np.maximum.accumulate(equity), peak)
                peak, low, fall = peaks[-1], min(low, equity.min()), max(fall, ((peaks - equity) / peaks).max())
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([float(start + total)]), pa.array([float(fall)]), pa.array([bool(low <= ruin * start)])], names=["run", "final_equity", "max_dd", "ruined"])

    dealt = mc_blocks(returns).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(max(tasks, 1) - 1))))
    return dealt.repartitionById(max(tasks, 1), "task").mapInArrow(fold, "run long, final_equity double, max_dd double, ruined boolean")


def mc_summary(paths: DataFrame, start: float = 100_000.0) -> DataFrame:
    q = lambda c, p, n: F.percentile(c, F.lit(p)).alias(n)
    return paths.agg(F.count("*").alias("runs"), F.avg("final_equity").alias("equity_mean"), q("final_equity", 0.05, "equity_p05"), q("final_equity", 0.5, "equity_p50"), q("final_equity", 0.95, "equity_p95"), F.avg("max_dd").alias("dd_mean"), q("max_dd", 0.5, "dd_p50"), q("max_dd", 0.95, "dd_p95"), F.avg((F.col("final_equity") > start).cast("double")).alias("p_profit"), F.avg(F.col("ruined").cast("double")).alias("p_ruin"))


# The wording of the summaries.
def mc_text() -> Column:
    """Text of a row of mc_summary."""
    return F.format_string(
        "Monte Carlo (%d runs):\n  Final Equity   mean=%,.0f  median=%,.0f  p05=%,.0f  p95=%,.0f\n  Max Drawdown   mean=%.2f%%  p95=%.2f%% (bad case)\n  P(profitable)  %.1f%%\n  P(ruin@50%%)    %.2f%%",
        F.col("runs"), F.col("equity_mean"), F.col("equity_p50"), F.col("equity_p05"), F.col("equity_p95"), F.col("dd_mean") * 100, F.col("dd_p95") * 100, F.col("p_profit") * 100, F.col("p_ruin") * 100,
    )


def sensitivity_text(keys: list[str]) -> Column:
    """Text of a row of sensitivity_summary over the parameters named."""
    own = "[" + ", ".join(repr(k) for k in keys) + "]"
    none = F.when(F.col("combos") == 0, "Sensitivity: no results.").when(F.col("sharpe_mean").isNull(), F.format_string("Sensitivity (%d configs): no completed runs.", "combos"))
    text = F.format_string(f"Sensitivity (%d configs over {own}):\n  Sharpe        mean=%s  std=%s  min=%s  max=%s\n  Profit Factor mean=%s  std=%s\n  Stability (mean/std Sharpe): %s", "combos", *[fixed(c, 2) for c in ("sharpe_mean", "sharpe_std", "sharpe_min", "sharpe_max", "pf_mean", "pf_std", "stability")])
    return F.coalesce(none, text)

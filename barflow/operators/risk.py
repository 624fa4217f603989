"""Stateless risk checks, sizes and correlation look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .signals import reward_risk


def position_size(cfg: dict = DEFAULTS, equity: float | Column = 100_000.0) -> dict[str, Column]:
    """size_mult, qty and risk of a signal: risk grows with conviction, notional stays within equity."""
    c = cfg["risk"]
    eq = F.lit(equity) if not isinstance(equity, Column) else equity
    mult = c["conviction_min"] + (c["conviction_max"] - c["conviction_min"]) * F.col("conviction")
    dist = F.abs(F.col("entry") - F.col("stop"))
    qty = F.when(dist > 0, F.least(c["risk_pct"] * eq * mult / F.nullif(dist, F.lit(0.0)), eq / F.col("entry"))).otherwise(0.0)
    return {"size_mult": mult, "qty": qty, "risk": qty * dist}


def gate_reason(cfg: dict = DEFAULTS) -> Column:
    """First failed stateless gate of a signal with qty, or NULL."""
    rr = reward_risk(F.col("entry"), F.col("stop"), F.col("take_profit"))
    wrong = ((F.col("side") == "long") & (F.col("stop") >= F.col("entry"))) | ((F.col("side") == "short") & (F.col("stop") <= F.col("entry")))
    return F.when(rr < cfg["risk"]["min_rr"], "reward_risk").when(wrong, "stop_side").when(F.col("qty") <= 0, "qty")


def clusters(spark: SparkSession, cfg: dict = DEFAULTS) -> DataFrame:
    """symbol, cluster_id: the first cluster that names a symbol."""
    rows = spark.createDataFrame([(k, s) for k, own in enumerate(cfg["clusters"]) for s in own], "cluster_id int, symbol string")
    return rows.groupBy("symbol").agg(F.min("cluster_id").alias("cluster_id"))


def cluster_conflicts(candidates: DataFrame, positions: DataFrame, membership: DataFrame) -> DataFrame:
    """Candidates of a cluster in which another symbol is open."""
    m = F.broadcast(membership)  # one row a configured symbol
    held = positions.join(m, "symbol").select(F.col("cluster_id").alias("held_cluster"), F.col("symbol").alias("held"))
    own = candidates.join(m, "symbol")
    return own.join(held, (F.col("cluster_id") == F.col("held_cluster")) & (F.col("symbol") != F.col("held")), "left_semi")


def class_counts(positions: DataFrame, cfg: dict = DEFAULTS) -> DataFrame:
    """Open positions a class with its cap and whether there is room."""
    caps = F.create_map(*[x for k, v in cfg["class_caps"].items() for x in (F.lit(k), F.lit(v))])
    out = positions.groupBy("asset_class").agg(F.count("*").alias("n_open"))
    return out.withColumn("cap", F.try_element_at(caps, "asset_class")).withColumn("has_room", F.coalesce(F.col("n_open") < F.col("cap"), F.lit(True)))


def unrealized(mark: Column) -> Column:
    return F.when(F.col("side") == "long", mark - F.col("entry_price")).otherwise(F.col("entry_price") - mark) * F.col("qty")


def r_multiple(mark: Column) -> Column:
    risk = F.abs(F.col("entry_price") - F.col("initial_stop"))
    return F.coalesce(F.when(F.col("side") == "long", mark - F.col("entry_price")).otherwise(F.col("entry_price") - mark) / F.nullif(risk, F.lit(0.0)), F.lit(0.0))


def exit_check(side: Column, high: Column, low: Column, stop: Column, target: Column) -> dict[str, Column]:
    """How a bar ends a position: exit_reason (`stop` before `take_profit`, else NULL) and exit_price, the level itself."""
    long = side == "long"
    stopped = F.when(long, low <= stop).otherwise(high >= stop)
    reached = F.when(long, high >= target).otherwise(low <= target)
    return {"exit_reason": F.when(stopped, "stop").when(reached, "take_profit"), "exit_price": F.when(stopped, stop).when(reached, target)}


def with_universe(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows with their symbol's asset_class, broker and adapter; unknown symbols have none.  universe: a row a symbol, of which there are few."""
    from ..sources.bars import small

    return rows.join(small(universe.select("symbol", "asset_class", "broker", "adapter").dropDuplicates(["symbol"])), "symbol", "left")

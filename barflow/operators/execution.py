"""Order simulation: fill rule, slippage, netting, limit prices, fill statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_price() -> Column:
    """Price at which a bar fills an order (type, side, limit_price, stop_price), or NULL."""
    buy, limit, stop, o = F.col("side") == "buy", F.col("limit_price"), F.col("stop_price"), F.col("open")
    return (
        F.when(F.col("type") == "market", o)
        .when((F.col("type") == "limit") & buy & (F.col("low") <= limit), F.least(limit, o))
        .when((F.col("type") == "limit") & ~buy & (F.col("high") >= limit), F.greatest(limit, o))
        .when((F.col("type") == "stop") & buy & (F.col("high") >= stop), F.greatest(stop, o))
        .when((F.col("type") == "stop") & ~buy & (F.col("low") <= stop), F.least(stop, o))
    )


def slipped(price: Column, bps: float) -> Column:
    return price * F.when(F.col("side") == "buy", 1.0 + bps / 1e4).otherwise(1.0 - bps / 1e4)


#: Children of a node in the search tree over a symbol's bars, as a power of two.
_FAN = 5


def _numbered(orders: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with their place n in the symbol's history, and orders with the place of the first later bar."""
    at = bars.select("symbol", "ts", F.lit(0).alias("late"), F.struct("open", "high", "low").alias("bar"), F.lit(None).cast(orders.select(F.struct(*orders.columns)).dtypes[0][1]).alias("order"))
    sent = orders.select("symbol", "ts", F.lit(1).alias("late"), F.lit(None).cast(at.schema["bar"].dataType).alias("bar"), F.struct(*orders.columns).alias("order"))
    seen = F.sum(1 - F.col("late")).over(Window.partitionBy("symbol").orderBy("ts", "late").rowsBetween(Window.unboundedPreceding, 0))
    both = at.unionByName(sent).withColumn("seen", seen)
    return both.filter("late = 0").select("symbol", F.col("ts").alias("bar_ts"), (F.col("seen") - 1).alias("n"), "bar.*"), both.filter("late = 1").select("order.*", F.col("seen").alias("n"))


def _tree(bars: DataFrame, levels: int) -> DataFrame:
    """symbol, level, parent, children: lowest low, highest high and presence of an open in each child, at most 2 ** _FAN of them."""
    blocks = bars.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("block", F.expr(f"shiftright(n, {_FAN} * level)"))
    stats = blocks.groupBy("symbol", "level", "block").agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.max(F.col("open").isNotNull()).alias("op"))
    return stats.groupBy("symbol", "level", F.shiftright("block", _FAN).alias("parent")).agg(F.array_sort(F.collect_list(F.struct("block", "lo", "hi", "op"))).alias("children"))


def _first_child(since: Column) -> Column:
    """First child block from `since` on in which some bar fills the order, or NULL."""

    def fills(x: Column) -> Column:
        return F.when(F.col("type") == "market", x["op"]).when(F.col("down"), x["lo"] <= F.col("price")).otherwise(x["hi"] >= F.col("price"))

    return F.get(F.filter("children", lambda x: (x["block"] >= since) & fills(x)), F.lit(0))["block"]


def first_fills(orders: DataFrame, bars: DataFrame, bps: float = 3.0) -> DataFrame:
    """Each order's first filling bar after it was submitted (ts), slipped; order_id is unique.

    Bars form a tree of lows and highs.  An order meets one node a level on
    the way up, right of its place, then one a level down to its bar, so its
    cost is the tree's depth however long the history or the wait is.  An
    order without its price, side or a filling bar has no row.
    """
    longest = bars.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
    levels = max(1, -(-int(longest).bit_length() // _FAN))
    numbered, sent = _numbered(orders, bars)
    buy, limit, stop = F.col("side") == "buy", F.col("type") == "limit", F.col("type") == "stop"
    sent = sent.withColumn("price", F.when(F.col("side").isNotNull() & limit, F.col("limit_price")).when(F.col("side").isNotNull() & stop, F.col("stop_price"))).withColumn("down", buy == limit)
    tree = _tree(numbered, levels)

    # up: blocks of a level begin right of what the level below has covered, rounded up
    up = sent.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    up = up.withColumn("since", F.expr(f"shiftright(n + shiftleft(1L, {_FAN} * level) - 1, {_FAN} * level)")).withColumn("parent", F.shiftright("since", _FAN))
    hits = up.join(tree, ["symbol", "level", "parent"]).withColumn("block", _first_child(F.col("since"))).filter("block IS NOT NULL")
    keep = [*orders.columns, "price", "down", "level", "block"]
    found = hits.groupBy("order_id").agg(F.min_by(F.struct(*keep), "level").alias("x")).select("x.*")

    # down: an order that is not at this level takes a key of its own that no node has
    aside = -1 - F.pmod(F.xxhash64("order_id"), F.lit(1 << 31))
    for level in range(levels - 1, 0, -1):
        here = F.col("level") == level
        below = tree.filter(F.col("level") == level - 1).select("symbol", "parent", "children")
        found = found.withColumn("parent", F.when(here, F.col("block")).otherwise(aside)).join(below, ["symbol", "parent"], "left")
        found = found.select(*orders.columns, "price", "down", F.when(here, level - 1).otherwise(F.col("level")).alias("level"), F.when(here, _first_child(F.lit(0))).otherwise(F.col("block")).alias("block"))
    met = found.join(numbered.withColumnRenamed("n", "block"), ["symbol", "block"]).withColumn("fill", fill_price()).filter("fill IS NOT NULL")
    return met.select("order_id", "symbol", "side", "type", "qty", "bar_ts", slipped(F.col("fill"), bps).alias("fill_price"))


def limit_price(bps: float = 2.0, valid: Column | None = None) -> Column:
    """A passive limit at the middle of a valid quote, less (buy) or more (sell) the offset; NULL means market.

    A quote is valid if both its sides are above zero; valid: another rule, for
    instruments whose prices may be zero or less.
    """
    mid = (F.col("bid") + F.col("ask")) / 2
    ok = (F.col("bid") > 0) & (F.col("ask") > 0) if valid is None else valid
    return F.when(ok, mid * F.when(F.col("side") == "buy", 1.0 - bps / 1e4).otherwise(1.0 + bps / 1e4))


def route(elapsed_s: Column, timeout_s: float, fallback: list[str]) -> Column:
    """What becomes of a limit order: waits, is cancelled, or goes to the market for listed strategies."""
    return F.when(elapsed_s < timeout_s, "open").when(F.col("strategy").isin(*fallback), "market").otherwise("cancelled")


def slippage_bps() -> Column:
    return F.when(F.col("side") == "buy", F.col("fill_price") - F.col("intended_price")).otherwise(F.col("intended_price") - F.col("fill_price")) / F.nullif("intended_price", F.lit(0.0)) * 1e4


def netting(fills: DataFrame, fee_bps: float = 5.0) -> DataFrame:
    """Final position of each symbol after its fills in order: averages in, reduces, drops what exceeds a close.

    The fold is an aggregate over the symbol's ordered fills, inside the JVM.
    A fill of no quantity changes nothing; a flat position has average price 0.
    """
    ordered = fills.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty")).alias("q"), "price"))).alias("f"))
    zero = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("avg"), F.lit(0.0).alias("realised"), F.lit(0.0).alias("fees"))

    def step(s: Column, f: Column) -> Column:
        same = (s["pos"] == 0) | (F.signum(s["pos"]) == F.signum(f["q"]))
        closed = F.least(F.abs(s["pos"]), F.abs(f["q"]))
        pos = F.when(same, s["pos"] + f["q"]).otherwise(s["pos"] - F.signum(s["pos"]) * closed)
        avg = F.when(same, F.coalesce((F.abs(s["pos"]) * s["avg"] + F.abs(f["q"]) * f["price"]) / F.nullif(F.abs(s["pos"]) + F.abs(f["q"]), F.lit(0.0)), F.lit(0.0))).when(pos == 0, 0.0).otherwise(s["avg"])
        won = F.when(same, 0.0).otherwise(F.signum(s["pos"]) * (f["price"] - s["avg"]) * closed)
        return F.struct(pos.alias("pos"), avg.alias("avg"), (s["realised"] + won).alias("realised"), (s["fees"] + F.abs(f["q"]) * f["price"] * fee_bps / 1e4).alias("fees"))

    return ordered.select("symbol", F.aggregate("f", zero, step).alias("x")).select("symbol", F.col("x.pos").alias("position"), F.col("x.avg").alias("avg_price"), F.col("x.realised").alias("realised"), F.col("x.fees").alias("fees"))


def broker_equity(positions: DataFrame, quotes: DataFrame, cash: float) -> DataFrame:
    """Cash and positions at the bid."""
    return positions.join(quotes.select("symbol", "bid"), "symbol").agg((F.lit(cash) + F.sum(F.col("bid") * F.col("position"))).alias("equity"))


def submit(orders: DataFrame) -> DataFrame:
    return orders.withColumn("status", F.when(F.col("type") == "limit", "open").otherwise("pending"))


def cancel(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """Open orders named in ids (order_id) become cancelled; `cancelled` tells whether an order was."""
    hit = orders.join(ids.select("order_id").distinct().withColumn("_hit", F.lit(True)), "order_id", "left")
    done = F.col("_hit").isNotNull() & F.col("status").isin("open", "pending")
    return hit.withColumns({"cancelled": done, "status": F.when(done, "cancelled").otherwise(F.col("status"))}).drop("_hit")


def get_orders(orders: DataFrame, ids: DataFrame) -> DataFrame:
    """The orders named in ids (order_id) as they stand; unknown ids give no row."""
    return orders.join(ids.select("order_id").distinct(), "order_id", "left_semi")


def quote_mid() -> Column:
    """The middle of a valid quote, else NULL."""
    return F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("bid") + F.col("ask")) / 2)


def market_orders(signals: DataFrame) -> DataFrame:
    """Market orders of signals (side long or short, entry, qty, bid, ask): intended at the middle, or at the entry without a valid quote."""
    return signals.withColumns({"side": F.when(F.col("side") == "long", "buy").otherwise("sell"), "type": F.lit("market"), "intended_price": F.coalesce(quote_mid(), "entry")})


def exit_orders(positions: DataFrame) -> DataFrame:
    """Market orders that close positions (side, strategy, reason, bid, ask): the opposite side, logged as `<strategy>-exit:<reason>`."""
    return positions.withColumns({
        "side": F.when(F.col("side") == "long", "sell").otherwise("buy"), "type": F.lit("market"), "intended_price": F.coalesce(quote_mid(), F.lit(0.0)), "strategy": F.concat("strategy", F.lit("-exit:"), "reason"),
    })


def entry_orders(signals: DataFrame, fills: DataFrame, timeout_s: float = 30, fallback: list[str] = ("momentum", "breakout"), bps: float = 2.0) -> DataFrame:
    """The life of each entry (order_id, side buy or sell, strategy, bid, ask, submit_ts): a limit order at the middle less the offset, polled until the timeout.

    fills: order_id, fill_ts of limit orders.  outcome: `filled` in time, else the limit is cancelled and goes to the `market` for the
    listed strategies, or is `cancelled`; an invalid quote goes to the market at once.  decided_ts: when that is known.
    """
    met = signals.withColumn("limit_price", limit_price(bps)).join(fills.groupBy("order_id").agg(F.min("fill_ts").alias("fill_ts")), "order_id", "left")
    due = F.col("submit_ts") + F.make_dt_interval(secs=F.lit(float(timeout_s)))
    filled = F.col("limit_price").isNotNull() & (F.col("fill_ts") <= due)
    outcome = F.when(F.col("limit_price").isNull(), "market").when(filled, "filled").when(F.col("strategy").isin(*fallback), "market").otherwise("cancelled")
    return met.withColumns({"outcome": outcome, "decided_ts": F.when(F.col("limit_price").isNull(), F.col("submit_ts")).when(filled, F.col("fill_ts")).otherwise(due), "intended_price": F.when(outcome == "filled", F.col("limit_price")).otherwise(quote_mid())})


def latest_marks(bars: DataFrame) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")

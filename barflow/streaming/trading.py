"""Live trading from ticks: closed bars of two timeframes, signals and the position fold, one micro-batch at a time.

Each micro-batch of closed bars runs the batch engine's own columns over the
last `history` bars of each symbol and timeframe, then folds the new ones into
the account.  What lies between batches, the bars and the pickled account, is a
table a batch in the shared folder, so a batch that is run again after a
failure finds the state before it and writes the same rows.

A longer bar counts from its close on (its label is moved there), so nothing is
known early.  As a signal fills at the open of the bar after the next step, the
fold stays one bar behind: it goes up to the time by which every symbol still
trading has a following bar.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions.timeframe import seconds
from ..operators.backtest import fold_rows
from ..operators.fold import Bar, Simulator, event_frame
from ..operators.signals import enrich, with_signals
from ..schema import BAR, EVENT
from .gates import Calendar, gated
from .live import stream_bars

HISTORY = f"tf string, place long, {BAR}"
OUT = f"{EVENT}, sim binary"


def closed_bars(ticks: DataFrame, short: str = "15m", long: str = "1h", delay: str = "0 seconds", price: str = "px") -> DataFrame:
    """Closed bars of both timeframes of one stream of ticks, told apart by tf."""
    return stream_bars(ticks, short, delay, price).withColumn("tf", F.lit(short)).unionByName(stream_bars(ticks, long, delay, price).withColumn("tf", F.lit(long)))


def _read(spark: SparkSession, path: str, schema: str, there: bool) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def fold_account(cfg: dict[str, Any], account: str) -> Callable:
    """A cogroup function: rows to fold and the account's last state give its events and its next state."""

    def fold(rows, state):  # noqa: ANN001, ANN202
        sim = pickle.loads(state["sim"].iloc[0]) if len(state) else Simulator(cfg)
        for r in rows.sort_values(["ts", "symbol"]).itertuples(index=False):
            x = json.loads(r.signal) if isinstance(r.signal, str) else None
            x = tuple(x[c] for c in ("side", "strategy", "entry", "stop", "take_profit", "conviction")) if x else None
            sim.step(Bar(r.symbol, r.asset_class, int(r.place), 1 << 60, r.ts.to_pydatetime(), r.open, r.high, r.low, r.close, r.next_open, int(r.htf_rows), x))
        events, sim.events = sim.events, []
        return event_frame([*events, {"kind": "state", "sim": pickle.dumps(sim)}], account, OUT)

    return fold


def trade(bars: DataFrame, cfg: dict[str, Any], folder: str, short: str = "15m", long: str = "1h", history: int = 1000, stale: timedelta = timedelta(days=1), account: str = "live", asset_class: str = "crypto", calendar: Calendar | None = None, currencies: DataFrame | None = None, model: str | None = None):  # noqa: ANN201
    """A stream writer that trades closed bars (see closed_bars); events are parquet under folder/out, one directory a batch.

    calendar (read anew each batch) with currencies, and the path of a saved
    model, switch on the gates of streaming.gates.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, number > 0
        new = batch.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        old = _read(spark, f"{folder}/bars/{number - 1}", HISTORY, before)
        last = old.groupBy("tf", "symbol").agg(F.max("place").alias("_last"), F.max("ts").alias("_at"))
        fresh = new.join(last, ["tf", "symbol"], "left").filter("_at IS NULL OR ts > _at")
        own = Window.partitionBy("tf", "symbol").orderBy("ts")
        fresh = fresh.withColumn("place", F.row_number().over(own) + F.coalesce("_last", F.lit(-1).cast("long"))).select(*old.columns)
        newest = F.row_number().over(Window.partitionBy("tf", "symbol").orderBy(F.desc("ts")))
        kept = old.unionByName(fresh).withColumn("_r", newest).filter(F.col("_r") <= history).drop("_r")
        kept.write.mode("overwrite").parquet(f"{folder}/bars/{number}")

        kept = _read(spark, f"{folder}/bars/{number}", HISTORY, True)
        ltf = kept.filter(F.col("tf") == short).drop("tf")
        htf = kept.filter(F.col("tf") == long).drop("tf", "place").withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.lit(float(seconds(long)))))
        rows = fold_rows(gated(with_signals(enrich(ltf, htf, cfg), cfg), calendar, currencies, model, cfg), asset_class, F.col("place"), F.to_json("signal").alias("signal"), F.lit(account).alias("run_id"))
        known = ltf.withColumn("next", F.lead("ts").over(Window.partitionBy("symbol").orderBy("ts"))).groupBy("symbol").agg(F.max("ts").alias("last"), F.max(F.when(F.col("next").isNotNull(), F.col("ts"))).alias("ready"))
        end = known.agg(F.max("last")).first()[0]
        until = known.filter(F.col("last") >= F.lit(end - stale)).agg(F.min("ready")).first()[0] if end else None
        past = _read(spark, f"{folder}/cursor/{number - 1}", "ts timestamp_ntz", before).agg(F.max("ts")).first()[0]
        until = until if past is None or until is not None and until > past else past
        spark.createDataFrame([(until,)], "ts timestamp_ntz").write.mode("overwrite").parquet(f"{folder}/cursor/{number}")
        due = rows.filter("false") if until is None else rows.filter(F.col("ts") <= F.lit(until))
        due = due if past is None else due.filter(F.col("ts") > F.lit(past))
        state = _read(spark, f"{folder}/out/{number - 1}", OUT, before).filter("kind = 'state'").select("run_id", "sim")
        done = due.groupBy("run_id").cogroup(state.groupBy("run_id")).applyInPandas(fold_account(cfg, account), OUT)
        done.write.mode("overwrite").parquet(f"{folder}/out/{number}")

    return bars.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint")


def events_of(spark: SparkSession, folder: str) -> DataFrame:
    """All events that the account had so far."""
    return spark.read.schema(OUT).parquet(f"{folder}/out/*").filter("kind != 'state'").drop("sim")


class Heartbeat(StreamingQueryListener):
    """Calls beat(name, batch, rows, idle) after each batch and at each idle trigger of any query, and once more (batch -1) when one ends."""

    def __init__(self, beat: Callable[[str, int, int, bool], None]):
        self.beat, self.names = beat, {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.beat(p.name or str(p.id), p.batchId, p.numInputRows, p.numInputRows == 0)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self.beat(self.names.get(str(event.id), str(event.id)), -1, 0, True)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.beat(self.names.get(str(event.id), str(event.id)), -1, 0, True)


def stop_gracefully(queries: list[StreamingQuery], drain: bool = True) -> list[StreamingQuery]:
    """Let each query finish what has arrived (or only its running batch), then stop it; those that failed are returned."""
    for q in queries:
        try:
            if drain and q.isActive:
                q.processAllAvailable()
        except Exception:  # told by the query itself, below; the others are stopped all the same
            pass
        q.stop()
    return [q for q in queries if q.exception() is not None]

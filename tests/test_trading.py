"""Live trading from a stream of ticks equals the batch fold; heartbeats and stops."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow.operators import backtest as bt
from barflow.plans import queries as q
from barflow.streaming import live, trading

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def traded(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("live"))
    ticks = q.src.ticks(q.t(spark, SF, "events")).select("event_id", "symbol", "ts", "value", "px").withColumn("ts", F.col("ts").cast("timestamp")).persist()
    edges = [dt.datetime(2024, 1, d) for d in (1, 10, 17, 31)]
    stream = live.replay([ticks.filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))) for a, b in zip(edges, edges[1:])])
    beats = []
    listener = trading.Heartbeat(lambda *x: beats.append(x))
    spark.streams.addListener(listener)
    query = trading.trade(trading.closed_bars(stream), q.BT, base, history=1000).queryName("trading").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.streams.removeListener(listener)
    return base, beats


def test_ticks_to_trades_equal_the_batch(spark, traded):
    base, _ = traded
    ltf = q.bars(spark, SF)
    htf = q.bars(spark, SF, "1h").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    batch = [r for r in q.rounded(bt.trades_of(bt.simulate(bt.prepared(ltf, htf, q.BT), q.BT, True)), 6).orderBy("seq").collect() if r.exit_reason != "end_of_data"]
    events = trading.events_of(spark, base).persist()
    got = q.rounded(bt.trades_of(events), 6).orderBy("seq").collect()
    end = events.agg(F.max("ts")).first()[0]
    want = [r for r in batch if r.exit_time <= end]
    assert len(got) > 50 and [tuple(r)[1:] for r in got] == [tuple(r)[1:] for r in want]
    assert end > dt.datetime(2024, 1, 29)


def test_heartbeats(traded):
    _, beats = traded
    assert {b[0] for b in beats} == {"trading"} and sum(b[2] for b in beats) > 5000


def test_stop_after_what_has_arrived(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("x").alias("v"))
    stream = live.replay([rows])
    seen = []
    one = stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "a")).start()
    bad = stream.writeStream.foreachBatch(lambda b, n: 1 / 0).option("checkpointLocation", str(tmp_path / "b")).start()
    assert trading.stop_gracefully([one, bad]) == [bad] and sum(seen) == 100 and not one.isActive and not bad.isActive

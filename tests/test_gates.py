"""Gates on a stream give the batch's verdicts, with the calendar and the model as they are at each batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow.operators import ml
from barflow.operators.signals import blackout
from barflow.plans import queries as q
from barflow.sources.ledger import Ledger
from barflow.streaming import gates

T0 = dt.datetime(2024, 1, 3)
EVENTS = "time timestamp_ntz, currency string, impact string, name string"


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    rows = spark.createDataFrame([(float(k % 2), float(k % 2) + 0.001 * k) for k in range(140)], "label double, x double")
    path = str(tmp_path_factory.mktemp("model") / "m")
    ml.save_model(ml.train_gbt(rows, ["x"], rounds=3, depth=2), path)
    return path


def test_stream_gives_the_verdicts_of_the_batch(spark, tmp_path, model):
    rows = spark.createDataFrame([("AB"[k % 2], T0 + dt.timedelta(minutes=5 * k), (k * 7 % 10) / 10) for k in range(100)], "symbol string, ts timestamp_ntz, x double")
    currencies = spark.createDataFrame([("A", ["USD"]), ("B", ["EUR", "USD"])], "symbol string, currencies array<string>")
    first = [(T0 + dt.timedelta(minutes=60), "USD", "high", "jobs")]
    later = [*first, (T0 + dt.timedelta(minutes=400), "EUR", "high", "rate"), (T0 + dt.timedelta(minutes=300), "USD", "low", "talk")]
    held = [first]
    ledger = Ledger(spark, str(tmp_path), "gated")
    handle = gates.gate_batches(ledger, lambda: spark.createDataFrame(held[0], EVENTS), currencies, model, 15, 0.5)
    for n, part in enumerate(("ts < '2024-01-03 03:00'", "ts >= '2024-01-03 03:00'")):
        rows.filter(part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        held[0] = later  # the calendar grows between the batches
    got = sorted((r.symbol, r.ts, round(r.score, 9)) for r in spark.read.parquet(ledger.root).collect())
    free = blackout(rows, spark.createDataFrame(later, EVENTS), currencies, 15).filter("blackout IS NULL")
    want = sorted((r.symbol, r.ts, round(r.score, 9)) for r in ml.score_gate(ml.score(ml.load_model(model), free), 0.5).collect())
    assert got == want and 10 < len(want) < free.count() < 100


def test_verdicts_of_bars_with_signals(spark):
    sf = "/root/testdata/sf0.01"
    rows = q.with_signals(spark, sf).persist()
    signalled = rows.filter("signal IS NOT NULL")
    at = signalled.filter("symbol = 'view'").agg(F.min("ts")).first()[0]
    events = spark.createDataFrame([(at, "USD", "high", "jobs")], EVENTS)
    currencies = spark.createDataFrame([("view", ["USD"])], "symbol string, currencies array<string>")
    out = gates.verdicts(rows, events, currencies, None, q.CFG).filter("refused IS NOT NULL").collect()
    assert {(r.symbol, r.refused) for r in out} == {("view", "blackout")} and at in {r.ts for r in out}
    assert all(abs((r.ts - at).total_seconds()) <= 900 for r in out)
    kept = gates.gated(rows, lambda: events, currencies, None, q.CFG)
    assert kept.columns == rows.columns and kept.count() == rows.count() and kept.filter("signal IS NOT NULL").count() == signalled.count() - len(out)
    rows.unpersist()

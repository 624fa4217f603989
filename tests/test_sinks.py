"""Files, alerts and readers against hand-worked rows."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import backtest as bt
from barflow.operators import metrics as mt
from barflow.operators import ml, signals, views
from barflow.config import with_settings
from barflow.plans import queries as q
from barflow.sources import bars as src
from barflow.sources import sinks
from barflow.streaming import live

T0 = dt.datetime(2024, 1, 1)


def lines(spark, path):
    return [tuple(r) for r in spark.read.option("header", True).csv(path).collect()], spark.read.option("header", True).csv(path).columns


def test_trades_and_equity_files(spark, tmp_path):
    rows = [("S", "long", "momentum", T0, T0, 1.0, 2.0, 3.0, 4.0, 1.5, "stop", "more")]
    trades = spark.createDataFrame(rows, "symbol string, side string, strategy string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, qty double, pnl double, r_multiple double, exit_reason string, run_id string")
    assert sinks.write_trades(trades, str(tmp_path / "t")) and not sinks.write_trades(trades.filter("false"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    got, columns = lines(spark, str(tmp_path / "t"))
    assert columns == sinks.TRADE_COLUMNS and got[0][0] == "S" and got[0][8] == "4.0"
    sinks.write_equity(spark.createDataFrame([(T0, 5.0, "x")], "ts timestamp_ntz, equity double, symbol string"), str(tmp_path / "e"))
    assert lines(spark, str(tmp_path / "e"))[1] == ["timestamp", "equity"]


def test_walkforward_and_sensitivity_files(spark, tmp_path):
    results = mt.compute_metrics(q.trades(spark, "/root/testdata/sf0.001").withColumn("run_id", F.lit("0")))
    windows = spark.createDataFrame([(0, T0, T0)], "window int, test_start timestamp_ntz, test_end timestamp_ntz")
    sinks.write_walkforward(results, windows, str(tmp_path / "w"))
    got, columns = lines(spark, str(tmp_path / "w"))
    assert columns[-3:] == sinks.WALK_COLUMNS and len(got) == 1 and "sharpe" in columns
    ok = results.withColumns({"a": F.lit(1), "error": F.lit(None).cast("string")})
    sinks.write_sensitivity(ok, ["a"], str(tmp_path / "s"))
    assert lines(spark, str(tmp_path / "s"))[1] == ["a", *sinks.SENSITIVITY_COLUMNS]
    sinks.write_sensitivity(ok.withColumn("error", F.lit("bad")), ["a"], str(tmp_path / "f"))
    assert lines(spark, str(tmp_path / "f"))[1][-1] == "error"


def test_fill_log(spark, tmp_path):
    rows = [(T0, T0, "S", "buy", "m", 1.5, 100.0, 100.25, 25.0, "limit", "filled", "paper", 12.4), (T0, None, "S", "buy", "m", 2.0, None, None, 0.0, "market", "rejected", "paper", 0.0)]
    fills = spark.createDataFrame(rows, "submit_ts timestamp_ntz, fill_ts timestamp_ntz, symbol string, side string, strategy string, qty double, intended_price double, fill_price double, slippage_bps double, order_type string, status string, broker string, latency_ms double")
    for _ in range(2):
        sinks.append_fills(fills, str(tmp_path / "l"))
    got, columns = lines(spark, str(tmp_path / "l"))
    assert len(got) == 4 and len(columns) == 13
    first = {r[10]: r for r in got}
    assert first["filled"][5:9] == ("1.50000000", "100.00000000", "100.25000000", "25.00") and first["rejected"][1] is None and first["rejected"][6] is None


def test_fill_batches_are_written_once(spark, tmp_path):
    """A batch run twice, one that fails between write and commit, and a query that starts anew."""
    from barflow.sources.ledger import Ledger

    fills = spark.createDataFrame([(T0, T0, "S", "buy", "m", 1.5, 100.0, 100.25, 25.0, "limit", "filled", "paper", 12.4)], "submit_ts timestamp_ntz, fill_ts timestamp_ntz, symbol string, side string, strategy string, qty double, intended_price double, fill_price double, slippage_bps double, order_type string, status string, broker string, latency_ms double")
    ledger = Ledger(spark, str(tmp_path), "fills")
    write = sinks.fill_batches(ledger)
    write(fills, 0)
    write(fills, 0)
    assert sinks.read_fills(ledger).count() == 1

    def crash():
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        ledger.write(1, lambda path: sinks.fill_log(fills).write.option("header", True).csv(path), crash)
    assert sinks.read_fills(ledger).count() == 1 and not ledger.has(1)
    again = Ledger(spark, str(tmp_path), "fills")
    for n in (1, 1, 2):
        sinks.fill_batches(again)(fills, n)
    got = sinks.read_fills(again)
    assert got.count() == 3 and len(got.columns) == 14 and {r.batch for r in got.collect()} == {0, 1, 2}


def test_streamed_fills_survive_a_failed_batch(spark, tmp_path):
    """The stream fails after its commit, before its checkpoint knows: the batch runs again and writes nothing."""
    from barflow.sources.ledger import Ledger

    spark.range(5).write.parquet(f"{tmp_path}/in")
    ledger, runs = Ledger(spark, str(tmp_path), "rows"), []

    def handle(batch, number):
        ledger.write(number, lambda path: batch.write.parquet(path))
        runs.append(number)
        if len(runs) == 1:
            raise OSError("lost after the commit")

    for _ in range(2):
        query = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.foreachBatch(handle).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            assert len(runs) == 1
    assert runs == [0, 0] and spark.read.parquet(ledger.root).count() == 5


def test_alerts_are_sent_once(spark, tmp_path):
    from barflow.sources.ledger import Ledger

    rows = spark.createDataFrame([("EXIT", T0, "a", "b"), ("EXIT", T0, "a", "b"), ("EXIT", T0, "c", "d")], "type string, ts timestamp_ntz, title string, body string")
    sent, other = [], []

    def stops(alert):
        sent.append(alert["title"])
        if len(sent) == 2:
            raise KeyboardInterrupt  # the driver goes down in the middle of the batch

    send = sinks.fan_out([stops, lambda a: other.append(a["title"])], None, Ledger(spark, str(tmp_path), "alerts"))
    with pytest.raises(KeyboardInterrupt):
        send(rows, 7)
    for _ in range(2):
        sinks.fan_out([stops, lambda a: other.append(a["title"])], None, Ledger(spark, str(tmp_path), "alerts"))(rows, 7)
    assert sorted(sent) == ["a", "a", "c"] == sorted(other)
    send(rows, 8)
    assert len(sent) == 6


def test_alert_channels(spark, capsys):
    got = []

    class Hook(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Hook)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([("EXIT", T0, "a", "b"), ("INFO", T0, "c", "d")], "type string, ts timestamp_ntz, title string, body string")

    def broken(alert):
        raise OSError("down")

    sinks.fan_out([broken, sinks.console, sinks.webhook(f"http://127.0.0.1:{server.server_port}/")], {"EXIT"})(rows, 0)
    server.shutdown()
    assert got == [{"text": "a\nb"}] and "EXIT: a b" in capsys.readouterr().out


def test_rotating_log(tmp_path):
    log = sinks.setup_logging(str(tmp_path / "x.log"), size=200, copies=2)
    for k in range(20):
        log.info("line %d", k)
    log.handlers.pop().close()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.log", "x.log.1", "x.log.2"]


def test_vendor_rows(spark):
    fx = spark.createDataFrame([("E", {"time": "2024-01-01T00:00:00Z", "complete": True, "mid": {"o": "1.1", "h": "1.3", "l": "1.0", "c": "1.2"}, "volume": 7}), ("E", {"time": "2024-01-01T00:05:00Z", "complete": False, "mid": {"o": "1", "h": "1", "l": "1", "c": "1"}, "volume": 1})], "symbol string, candle struct<time: string, complete: boolean, mid: struct<o: string, h: string, l: string, c: string>, volume: long>")
    got = src.vendor_reader("forex")(fx).collect()
    assert [(r.ts, r.open, r.high, r.low, r.close, r.volume) for r in got] == [(T0, 1.1, 1.3, 1.0, 1.2, 7.0)]
    assert src.vendor_reader("crypto") is src.crypto_candles and src.vendor_reader("equity") is src.normalize_bars
    with pytest.raises(ValueError, match="unknown venue"):
        src.vendor_reader("moon")


def test_rows_to_bars(spark):
    rows = [{"symbol": "S", "ts": T0, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "volume": 3.0}]
    got = src.rows_to_bars(spark, rows) if src.rows_to_bars.__code__.co_argcount == 2 else src.rows_to_bars(spark, rows, "S")
    assert got.count() == 1 and got.first().close == 1.5


def test_model_file_and_gate(spark, tmp_path):
    assert ml.load_model(str(tmp_path / "none")) is None
    rows = spark.createDataFrame([(float(k % 7), float(k % 3), int(k % 7 > 3)) for k in range(140)], "a double, b double, label int")
    model = ml.train_gbt(rows, ["a", "b"], rounds=3, depth=2)
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.score(ml.load_model(str(tmp_path / "m")), rows)
    assert [r.score for r in again.collect()] == [r.score for r in ml.score(model, rows).collect()]
    gated = ml.score_gate(again, 0.5)
    assert gated.count() == rows.filter("label = 1").count() and ml.score_gate(ml.score(None, rows)).count() == 140
    with pytest.raises(ValueError, match="at least 100"):
        ml.train_gbt(rows.limit(50), ["a", "b"])


def test_training_does_not_follow_partitions(spark, monkeypatch):
    """Every round ran a task for each of the given partitions, and subsamples differed with them."""
    from pyspark.ml import Pipeline

    rows = spark.createDataFrame([(k, float(k % 7), float((k * 7919) % 101), (k * 31) % 5 // 3) for k in range(300)], "n int, a double, b double, label int")
    fit, tasks, scores = Pipeline.fit, [], []
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: tasks.append(df.rdd.getNumPartitions()) or fit(self, df))
    for most, given in ((4096, rows.repartition(30)), (4096, rows.orderBy(F.desc("n")).coalesce(1)), (64, rows)):
        monkeypatch.setattr(ml, "TRAIN_ROWS", most, raising=False)
        model = ml.train_gbt(given, ["a", "b"], rounds=5, depth=2)
        scores.append([r.score for r in ml.score(model, rows).orderBy("n").collect()])
    assert tasks == [1, 1, 5] and scores[0] == scores[1] and len(set(scores[0])) > 2


def test_folds_of_a_model(spark, caplog):
    rows = spark.createDataFrame([("S", k, float(k % 7), float((k * 7919) % 101), int(k % 7 > 3)) for k in range(300)], "symbol string, n int, a double, b double, label int")
    got = ml.cross_validated_auc(rows, ["a", "b"], rounds=3, depth=2)
    assert len(got) == 5 and all(x == 1.0 for x in got.values())
    noise = ml.cross_validated_auc(rows.withColumn("label", F.pmod(F.xxhash64("n"), F.lit(2)).cast("int")), ["b"], rounds=2, depth=1)
    assert 0.3 < sum(noise.values()) / 5 < 0.7
    assert any("0.55" in r.message for r in caplog.records) or sum(noise.values()) / 5 >= 0.55


def test_supervised_restarts():
    pauses, runs = [], []

    class Query:
        def awaitTermination(self):  # noqa: N802
            runs.append(1)
            if len(runs) < 4:
                raise RuntimeError("lost")

    assert live.supervised(Query, lambda: False, 5.0, 8.0, pauses.append) == 3 and pauses == [5.0, 8.0, 8.0]


def test_squeeze_asks_for_a_narrow_band(spark):
    sf = "/root/testdata/sf0.01"
    count = lambda **c: signals.with_signals(q.enriched(spark, sf), with_settings(mean_reversion__oversold=35.0, mean_reversion__overbought=65.0, **c)).filter("mean_reversion IS NOT NULL").count()
    free, squeezed, never = count(), count(mean_reversion__squeeze_on=True, mean_reversion__squeeze_pct=0.005), count(mean_reversion__squeeze_on=True, mean_reversion__squeeze_pct=0.0)
    assert free > squeezed > never == 0


def test_registered_strategy(spark, monkeypatch):
    monkeypatch.setattr(signals, "STRATEGIES", dict(signals.STRATEGIES))
    monkeypatch.setattr(signals, "ELIGIBLE", {k: list(v) for k, v in signals.ELIGIBLE.items()})
    own = lambda cfg, names=None: F.when(F.col("atr") > 0, signals._signal("long", "always", F.col("close") - F.col("atr"), F.col("close") + 3 * F.col("atr"), F.lit(1.0)))
    signals.register("always", own, ["unknown", "ranging"])
    cfg = with_settings(enabled=["always"])
    got = signals.with_signals(q.enriched(spark, "/root/testdata/sf0.001"), cfg).filter("signal IS NOT NULL")
    assert {r.strategy for r in got.select("signal.strategy").distinct().collect()} == {"always"} and {r.regime for r in got.select("regime").distinct().collect()} <= {"unknown", "ranging"}


def test_failed_combinations_are_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows, settings, runs = bt.run_grid(q.bars(spark, sf), q.bars(spark, sf, "1h"), {"ema_fast": [9, 0, "x"], "risk.conviction_max": [1.0]}, q.BT)
    assert [r[2] is None for r in runs] == [True, False, False] and list(settings) == ["0"]
    settings["0"]["risk"].pop("risk_pct")  # fails in the fold
    frame = spark.createDataFrame([(k, e) for k, _, e in runs], "run_id string, error string")
    events = bt.simulate(rows, q.BT, True, runs=settings, catch=True).persist()
    got = bt.grid_results(mt.with_empty_runs(mt.compute_metrics(bt.trades_of(events)), frame.select("run_id")), events, frame).orderBy("run_id").collect()
    assert all(r.error and r.n_trades is None for r in got) and "risk_pct" in got[0].error and "ema_fast" in got[1].error


def test_grid_equals_single_runs(spark):
    sf = "/root/testdata/sf0.01"
    ltf, htf = q.bars(spark, sf).persist(), q.bars(spark, sf, "1h").persist()
    rows, settings, runs = bt.run_grid(ltf, htf, {"ema_fast": [7, 9], "breakout.lookback": [15, 20], "mean_reversion.bb_std": [2.0, 1.5]}, q.BT)
    got = q.rounded(bt.trades_of(bt.simulate(rows, q.BT, True, runs=settings)), 6).drop("run_id")
    for k in ("0", "7"):
        one = q.rounded(bt.trades_of(bt.simulate(bt.prepared(ltf, htf, settings[k]), settings[k], True)), 6).drop("run_id")
        mine = q.rounded(bt.trades_of(bt.simulate(rows.filter(F.col("run_id") == k), q.BT, True, runs=settings)), 6).drop("run_id")
        assert sorted(map(str, one.collect())) == sorted(map(str, mine.collect())) and one.count() > 20
    assert got.count() > 300


def test_texts(spark):
    row = spark.createDataFrame([(1000, 101234.5, 101000.0, 90000.25, 120000.75, 0.0512, 0.05, 0.12, 0.634, 0.0012)], "runs long, equity_mean double, equity_p50 double, equity_p05 double, equity_p95 double, dd_mean double, dd_p50 double, dd_p95 double, p_profit double, p_ruin double")
    assert row.select(mt.mc_text()).first()[0] == "Monte Carlo (1000 runs):\n  Final Equity   mean=101,235  median=101,000  p05=90,000  p95=120,001\n  Max Drawdown   mean=5.12%  p95=12.00% (bad case)\n  P(profitable)  63.4%\n  P(ruin@50%)    0.12%"
    none = mt.sensitivity_summary(mt.compute_metrics(q.trades(spark, "/root/testdata/sf0.001").filter("false")))
    assert none.select(mt.sensitivity_text(["a"])).first()[0] == "Sensitivity: no results."
    assert views.message_alerts(row.select(F.lit(T0).alias("ts"), F.lit("x").alias("body")), "ERROR").first().title == "Error"


def test_numbers_in_texts_are_rounded_by_their_exact_value(spark):
    """3.945 is a little less than it says and 0.125 an exact half; format_string gave 3.95 and 0.13."""
    from barflow.functions.texts import fixed

    rng = np.random.default_rng(2)
    values = [3.945, 1.005, 0.125, 0.375, -0.125, -0.001, 0.0, 1234567.125, -9876543.215, 1e12 + 0.125, *(float(x) for x in (rng.integers(-(10**9), 10**9, 3000) / 1000)), *(float(x) for x in rng.integers(-(10**7), 10**7, 3000) / 10000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (0, 1, 2, 4):
        got = df.select("v", fixed("v", places), fixed("v", places, grouped=True), fixed("v", places, grouped=True, signed=True)).collect()
        assert [tuple(r[1:]) for r in got] == [(f"{r.v:.{places}f}", f"{r.v:,.{places}f}", f"{r.v:+,.{places}f}") for r in got]
    trade = spark.createDataFrame([("A", "long", 3.945, 0.789, "stop", T0)], "symbol string, side string, pnl double, r_multiple double, exit_reason string, exit_time timestamp")
    assert views.alerts(trade, ["EXIT"]).first().body == "EXIT LONG A stop pnl 3.94 (0.79R)"
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double")
    assert [r[0] for r in odd.select(fixed("v", 2)).collect()] == [r[0] for r in odd.select(F.format_string("%.2f", "v")).collect()]

"""Streams with keyed state and timers equal the batch operators, over several micro-batches and after a restart."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators.asof import asof_backward
from barflow.operators.execution import entry_orders
from barflow.streaming import stateful as st

T0 = dt.datetime(2024, 1, 1)


class Feed:
    """Files of one kind of rows as a stream, a file a micro-batch, and what a query has written so far."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def add(self, df):
        df.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def stream(self, schema):
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")

    def run(self, out):
        q = out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.parquet(f"{self.folder}/out")


BARS = "side string, symbol string, ts timestamp, v long, pad double"


def split(stream):
    left = stream.filter("side = 'short'").select("symbol", "ts", "v")
    return left, stream.filter("side = 'long'").select("symbol", "ts", F.col("v").alias("long_v"), "pad")


def test_asof_stream_over_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("short", s, T0 + dt.timedelta(minutes=5 * k), k, None) for s in "AB" for k in range(60)] + [("long", s, T0 + dt.timedelta(minutes=20 * k), 100 + k, 0.5) for s in "A" for k in range(1, 15)]
    rows.append(("short", "Z", T0 + dt.timedelta(days=1), 0, None))  # moves the watermark past all others
    df = spark.createDataFrame(rows, BARS)
    feed = Feed(spark, str(tmp_path))
    cuts = [0, 77, 160, 301]
    parts = [df.filter((F.col("ts") >= F.lit(T0 + dt.timedelta(minutes=a))) & (F.col("ts") < F.lit(T0 + dt.timedelta(minutes=b)))) for a, b in zip(cuts, cuts[1:])]
    parts.append(df.filter(F.col("ts") >= F.lit(T0 + dt.timedelta(minutes=301))))
    for p in parts[:2]:
        feed.add(p.orderBy(F.rand(int(rng.integers(99)))))
    some = feed.run(st.asof_stream(*split(feed.stream(BARS)), "symbol", "ts", "1 minute"))
    n = some.count()
    assert 0 < n < 122
    for p in parts[2:]:
        feed.add(p)
    got = {(r.symbol, r.ts): (r.v, r.long_v, r.pad) for r in feed.run(st.asof_stream(*split(feed.stream(BARS)), "symbol", "ts", "1 minute")).collect()}
    want = {(r.symbol, r.ts): (r.v, r.long_v, r.pad) for r in asof_backward(*split(df), "symbol", "ts").filter("symbol != 'Z'").collect()}
    assert {k: v for k, v in got.items() if k[0] != "Z"} == want and len(want) == 120
    assert len({v[1] for v in want.values()}) > 10


def orders(n=240, seed=5):
    rng = np.random.default_rng(seed)
    made = []
    for k in range(n):
        bid = 0.0 if k % 10 == 0 else None if k % 17 == 0 else float(rng.random() * 100 + 1)
        made.append((k, "buy" if k % 2 else "sell", ["momentum", "breakout", "mean_reversion"][k % 3], bid, (bid or 5.0) + 0.01, T0 + dt.timedelta(seconds=int(k * 7))))
    fills = [(k, made[k][5] + dt.timedelta(seconds=float(s))) for k in range(n) for s in (rng.uniform(0, 60, int(rng.integers(0, 3)))).round(3)]
    return made, fills


ROWS = "kind string, order_id long, side string, strategy string, bid double, ask double, t timestamp"


def parted(stream):
    return stream.filter("kind = 'o'").select("order_id", "side", "strategy", "bid", "ask", F.col("t").alias("submit_ts")), stream.filter("kind = 'f'").select("order_id", F.col("t").alias("fill_ts"))


@pytest.mark.parametrize("batches", [3])
def test_order_outcomes_equal_the_batch(spark, tmp_path, batches):
    made, fills = orders()
    rows = [("o", *r) for r in made] + [("f", k, None, None, None, None, t) for k, t in fills] + [("f", -1, None, None, None, None, T0 + dt.timedelta(days=1))]
    df = spark.createDataFrame(rows, ROWS)
    want = {r.order_id: (r.outcome, r.decided_ts, r.intended_price) for r in entry_orders(*parted(df)).collect()}
    assert {w[0] for w in want.values()} == {"filled", "market", "cancelled"}
    feed = Feed(spark, str(tmp_path))
    edges = [T0 + dt.timedelta(seconds=600 * b) for b in range(batches)] + [T0 + dt.timedelta(days=2)]
    for a, b in zip(edges, edges[1:]):
        feed.add(df.filter((F.col("t") >= F.lit(a)) & (F.col("t") < F.lit(b))))
        got = feed.run(st.order_outcomes(*parted(feed.stream(ROWS))))  # stopped and started again after each file
    rows = got.collect()
    assert len(rows) == len(made)
    for r in rows:
        o, at, price = want[r.order_id]
        assert (r.outcome, r.decided_ts) == (o, at) and (r.intended_price == pytest.approx(price) if price is not None else r.intended_price is None)


def test_averages_take_every_row_of_one_time(spark, tmp_path):
    """With seq, rows of one time are rows of their own, over a restart too, and one seen before is still ignored."""
    from barflow.streaming.live import crossing_averages

    schema = "symbol string, ts timestamp, seq long, close double"
    made = [("A", T0 + dt.timedelta(minutes=k // 3), k, float(k * k % 17)) for k in range(60)]
    feed = Feed(spark, str(tmp_path))
    for part in (made[:31][::-1], made[29:]):
        feed.add(spark.createDataFrame(part, schema))
        out = feed.run(crossing_averages(feed.stream(schema), 2, 5, seq="seq"))
    fast, want = None, []
    for k, (_, ts, _, close) in enumerate(made):
        fast = close if fast is None else fast + 2 / 3 * (close - fast)
        want.append((ts, close, pytest.approx(fast) if k else None))
    got = sorted((r.ts, n, r.close, r.ema_fast) for n, r in enumerate(out.collect()))
    assert len(got) == 60 and sorted((t, c) for t, _, c, _ in got) == sorted((t, c) for t, c, _ in want)
    rows = {(r.ts, r.close): r.ema_fast for r in out.collect()}
    assert all(rows[t, c] == f for t, c, f in want if sum((t, c) == (u, d) for u, d, _ in want) == 1)


class Handle:
    """State of one key in memory."""

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    class Map(dict):
        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

        def getValue(self, k):  # noqa: N802
            return self[k]

        def removeKey(self, k):  # noqa: N802
            del self[k]

    def __init__(self):
        self.timers = set()

    getMapState = lambda self, *_: Handle.Map()  # noqa: E731, N815
    getValueState = lambda self, *_: Handle.Value()  # noqa: E731, N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class At:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


@pytest.mark.parametrize("kind", ["asof", "orders"])
def test_a_key_is_settled_some_cells_at_a_time(monkeypatch, kind):
    """All that waited under a key was one frame of the task."""
    import pandas as pd

    monkeypatch.setattr(st, "HELD_ROWS", 200, raising=False)
    rng, seen, got = np.random.default_rng(8), [], []
    if kind == "asof":
        proc, n, names = st.AsOf(), 4000, ["left", "right"]
        rows = pd.DataFrame({"side": rng.integers(0, 2, n), "at": rng.permutation(n) * 600_000_000 + 7, "row": [str(k) for k in range(n)]})
        end = int(rows["at"].max()) // 1000 + 1
        proc.texts = names
    else:
        proc, n, names = st.Orders(30, ["view"], 2.0), 3000, ["order_id", "outcome"]
        ids = np.repeat(rng.permutation(n // 2) * 64, 2)
        rows = pd.DataFrame({"kind": [0, 1] * (n // 2), "order_id": ids, "side": "buy", "strategy": "view", "bid": 1.0, "ask": 2.0, "at": ids * 1_000_000 + [0, 20_000_000] * (n // 2)})
        end = int(rows["at"].max()) // 1000 + 31_000
        proc.texts = ["outcome"]
    proc.keys, proc.out, handle = ["g"], names, Handle()
    proc.init(handle)
    settle = proc.settle
    proc.settle = lambda own, *rest: seen.append(len(own)) or settle(own, *rest)
    for part in np.array_split(np.arange(n), 3):
        proc.handleInputRows((1,), iter([rows.iloc[x] for x in np.array_split(part, 10)]), At(0))
    for watermark in (end // 3, end // 2, end):
        assert len(handle.timers) == 1
        if min(handle.timers) <= watermark:
            handle.timers.clear()
            got += [tuple(r) for f in proc.handleExpiredTimer((1,), At(watermark), None) for r in f.itertuples(index=False)]
    assert max(seen) < 500 < n and not proc.cells
    if kind == "asof":
        left, right = (rows[rows["side"] == k].sort_values("at") for k in (1, 0))
        want = pd.merge_asof(left, right, on="at")
        assert {a: b if isinstance(b, str) else None for a, b in got} == {a: b if isinstance(b, str) else None for a, b in zip(want["row_x"], want["row_y"])} and len(got) == len(left)
    else:
        assert sorted(got) == [(int(k), "filled") for k in sorted(set(ids))]

"""Queries over all their rows, against brute force on small tables."""

import datetime as dt
import hashlib
import random

import pytest

from test_execution import walk

from barflow.operators import metrics as mt
from barflow.plans import queries as q

START = dt.datetime(2024, 1, 1)


def write(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def ticks_dir(spark, tmp_path_factory):
    """Events with odd and even ids of two symbols, some days of them."""
    rng = random.Random(5)
    rows = [(k, START + dt.timedelta(minutes=7 * k, seconds=k % 50), rng.randint(1, 9), ("view", "click")[k % 2 if k % 3 else 0], float(rng.randint(100, 90000)) / 100) for k in range(1, 2400)]
    return write(spark, tmp_path_factory.mktemp("ticks"), "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_every_tick_is_an_order(spark, ticks_dir):
    b = [tuple(r) for r in q.bars(spark, ticks_dir).select("symbol", "ts", "open", "high", "low", "close").collect()]
    sent = {r.event_id: r for r in q.src.ticks(spark.read.parquet(f"{ticks_dir}/events.parquet")).collect()}
    want = {}
    for k, r in sent.items():
        side, kind = ("buy", "sell")[k % 2], ("market", "limit", "stop")[k % 3]
        if f := walk((k, r.symbol, r.ts, side, kind, 1.0 + k % 4, r.px + (k % 5 - 2) * 0.01, r.px + (k % 7 - 3) * 0.01), b):
            want[k] = (side, kind, f[0], round(f[1] * (1 + (3 if side == "buy" else -3) / 1e4), 9))
    got = {r.order_id: (r.side, r.type, r.bar_ts, r.fill_price) for r in q.fill_rule(spark, ticks_dir).collect()}
    assert got.keys() == want.keys() and all(got[k] == (*w[:3], pytest.approx(w[3], abs=2e-9)) for k, w in want.items())
    groups = {}
    for k, (side, kind, at, price) in want.items():
        slip = (price - sent[k].px) * (1 if side == "buy" else -1) / sent[k].px * 1e4
        groups.setdefault((kind, side), []).append((slip, (at - sent[k].ts).total_seconds() * 1000))
    slips = {(r.type, r.side): r for r in q.fill_slippage(spark, ticks_dir).collect()}
    assert slips.keys() == groups.keys() and len(groups) == 6
    for key, g in groups.items():
        assert slips[key].fills == len(g) and slips[key].slippage_bps == pytest.approx(sum(x for x, _ in g) / len(g), abs=1e-5) and slips[key].latency_ms == pytest.approx(sum(x for _, x in g) / len(g), abs=1)
    cancels = {r.order_id: r for r in q.order_cancel(spark, ticks_dir).collect()}
    assert cancels.keys() == sent.keys() and all(r.cancelled == (k % 60 == 0) for k, r in cancels.items())
    assert {r.status for k, r in cancels.items() if k % 3 == 1} == {"open"}


def met(signal, after):
    """Places of the first stop and target in the next bars, by a walk."""
    _, n, side, stop, target = signal
    ahead = [r for r in after if n < r.n <= n + 20]
    stops = [r.n for r in ahead if (r.low <= stop if side == "long" else r.high >= stop)]
    targets = [r.n for r in ahead if (r.high >= target if side == "long" else r.low <= target)]
    return min(stops, default=-1), min(targets, default=-1)


def outcome(stop_at, target_at):
    return None if stop_at == target_at == -1 else int(stop_at == -1 or -1 < target_at < stop_at)


def by_symbol(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.ts):
        out.setdefault(r.symbol, []).append(r)
    return out


def test_every_bar_is_labelled_on_both_sides(spark, ticks_dir):
    want = {}
    for symbol, own in by_symbol(q.bars(spark, ticks_dir).collect()).items():
        own = [type("Bar", (), {"n": k, **r.asDict()}) for k, r in enumerate(own, 1)]
        for r in own:
            for side, sign in (("long", 1), ("short", -1)):
                at = met((symbol, r.n, side, r.close - sign * 0.01, r.close + sign * 0.02), own[r.n : r.n + 20])
                if outcome(*at) is not None:
                    want[symbol, r.n, side] = (*at, outcome(*at))
    got = {(r.symbol, r.n, r.side): (r.stop_at, r.target_at, r.label) for r in q.barrier_labels(spark, ticks_dir).collect()}
    assert got == want and {side for _, _, side in want} == {"long", "short"}


def test_model_is_trained_on_all_labelled_signals(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.01", {}

    def train(rows, features, **settings):
        seen.update(rows=rows.collect(), features=features, settings=settings)

    monkeypatch.setattr(q.ml, "train_gbt", train)
    got = {(r.symbol, r.n): r.label for r in q.gbt_train_score(spark, sf).collect()}
    assert seen["features"] == q.ml.FEATURES and seen["settings"] == {}
    rows = by_symbol(q.with_signals(spark, sf).collect())
    place = {(r.symbol, r.n): (own, r) for own in rows.values() for r in own}
    want = {}
    for m in q.ml.feature_matrix(q.with_signals(spark, sf), q.CFG).collect():
        own, r = place[m.symbol, m.n]
        want[m.symbol, m.n] = outcome(*met((r.symbol, r.n, r.signal.side, r.signal.stop, r.signal.take_profit), own))
    assert got == want
    trained = {(r.symbol, r.n): r.label for r in seen["rows"]}
    assert trained == {k: v for k, v in want.items() if v is not None} and len(trained) >= 100
    assert {r.side for r in seen["rows"]} == {1.0, -1.0}


def test_windows_cover_every_bar(spark, monkeypatch):
    sf, seen = "/root/testdata/sf0.01", []
    whole = q.bt.run_windows
    monkeypatch.setattr(q.bt, "run_windows", lambda b, h, windows, cfg: seen.extend(windows) or whole(b, h, windows, cfg))
    runs = q.walkforward_metrics(spark, sf)
    times = [r.ts for r in q.bars(spark, sf).union(q.bars(spark, sf, "1h")).collect()]
    assert all(any(w["test_start"] <= x <= w["test_end"] for w in seen) for x in times)
    assert seen[0]["test_start"] == min(times) and seen[-1]["test_end"] == max(times)
    assert {r.run_id for r in runs.select("run_id").collect()} == {str(w["window"]) for w in seen}


def test_windows_grow_with_the_table():
    for hours in (0, 5, 8 * 24 - 1, 8 * 24, 100 * 24 + 7):
        end = START + dt.timedelta(hours=hours, minutes=15)
        w = mt.cover_windows(START, end)
        assert len(w) == max(1, hours // (8 * 24)) and (w[0]["test_start"], w[-1]["test_end"]) == (START, end)
        assert all(a["test_end"] == b["test_start"] for a, b in zip(w, w[1:]))
    assert mt.cover_windows(None, None) == []


def test_halt_edges_of_every_symbol(spark, ticks_dir):
    want = set()
    for symbol, own in by_symbol(q.bars(spark, ticks_dir).collect()).items():
        first, halted = {}, set()
        for r in own:
            loss = 1 - r.close / first.setdefault(r.ts.date(), r.close)
            if loss >= 0.0005 and r.ts.date() not in halted:
                halted.add(r.ts.date())
                want.add((symbol, r.ts))
    got = {(r.symbol, r.ts) for r in q.halt_edges(spark, ticks_dir).collect()}
    assert got == want and {s for s, _ in want} == {"view", "click"}


def test_monte_carlo_draws_from_all_trades(spark, tmp_path):
    rng = random.Random(1)
    orders = [(k * 300 + 7, rng.choice("OF"), 250000.0 + rng.gauss(0, 90000) - 4000, START, f"{k % 3}-X") for k in range(620)]
    orders = [(*o[:2], o[2] - (9e7 if k == 619 else 0), *o[3:]) for k, o in enumerate(orders)]
    d = write(spark, tmp_path, "orders", rng.sample(orders, len(orders)), "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    pnl = [(o[2] - 250000) / 10000 for o in orders]
    got = {r.run: r for r in q.mc_paths(spark, d).collect()}
    assert sorted(got) == list(range(1000))
    drawn = set()
    for run in range(1000):
        equity = peak = low = 100000.0
        fall = 0.0
        for k in range(len(pnl)):
            at = int(hashlib.md5(f"42:{run}:{k}".encode()).hexdigest()[:8], 16) % len(pnl)
            drawn.add(at)
            equity += pnl[at]
            peak, low = max(peak, equity), min(low, equity)
            fall = max(fall, (peak - equity) / peak)
        r = got[run]
        assert (r.final_equity, r.max_dd) == pytest.approx((equity, fall), abs=1e-5) and r.ruined == (low <= 50000)
    assert drawn == set(range(len(pnl)))
    s = q.mc_summary(spark, d).first()
    finals = [r.final_equity for r in got.values()]
    assert s.runs == 1000 and s.equity_mean == pytest.approx(sum(finals) / 1000, abs=1e-4)


def test_monte_carlo_numbers_over_blocks(spark):
    rows = [(k * 11 - 40, float(k)) for k in range(500)]
    got = mt.mc_returns(spark.createDataFrame(rows[::-1], "seq long, pnl double"), 1.0, block=64).orderBy("idx").collect()
    assert [(r.idx, r.r) for r in got] == [(k, float(k)) for k in range(500)]
    assert mt.mc_draws(spark, 1000, 0, 0).count() == 0


def test_monte_carlo_by_join_equals_monte_carlo_by_task(spark):
    tr = spark.createDataFrame([(k * 5, float((k * 7919) % 2001 - 1000)) for k in range(300)], "seq long, pnl double")
    two = [{r.run: (r.final_equity, r.max_dd, r.ruined) for r in mt.monte_carlo(tr, 40, start=3000.0, sent=sent).collect()} for sent in (10**6, 0)]
    assert two[0].keys() == two[1].keys() and all(a[:2] == pytest.approx(two[1][k][:2], abs=1e-6) and a[2] == two[1][k][2] for k, a in two[0].items())
    assert len({a[2] for a in two[0].values()}) == 2
    assert mt.monte_carlo(tr.filter("false"), 5).count() == 0


def test_draws_are_those_of_hashlib():
    from barflow.functions.draws import draws

    for head in ("42:0:", "42:999:", f"{10**30}:12345:"):
        for first, stop in ((0, 1), (0, 1200), (9_990, 10_020), (999_995, 1_000_005)):
            want = [int(hashlib.md5(f"{head}{k}".encode()).hexdigest()[:8], 16) % 9_000_000 for k in range(first, stop)]
            assert draws(head, first, stop, 9_000_000).tolist() == want


def test_monte_carlo_shuffles_no_draw_and_collects_no_return(spark, monkeypatch):
    """Beyond four million trades every draw was a shuffled row; below, all returns went through the driver."""
    rng = random.Random(4)
    tr = spark.createDataFrame([(k * 3, None if k == 5 else rng.gauss(0, 500)) for k in range(700)], "seq long, pnl double")
    want = {r.run: (r.final_equity, r.max_dd, r.ruined) for r in mt.monte_carlo(tr, 37, start=9000.0, sent=0).collect()}
    for name in ("mc_draws", "mc_paths"):
        monkeypatch.setattr(mt, name, lambda *_: pytest.fail("draws are rows"))
    monkeypatch.setattr(type(tr), "toArrow", lambda _: pytest.fail("returns on the driver"))
    monkeypatch.setattr(mt, "MC_BLOCK", 64)
    paths = mt.monte_carlo(tr, 37, start=9000.0)
    got = {r.run: (r.final_equity, r.max_dd, r.ruined) for r in paths.collect()}
    assert got.keys() == want.keys() and all(g[:2] == pytest.approx(want[k][:2], abs=1e-6) and g[2] == want[k][2] for k, g in got.items())
    assert mt.MC_HELD > 9_000_000

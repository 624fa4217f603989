"""The path-dependent position simulator: one ordered step a bar, for one symbol or a portfolio.

The same step serves the batch backtest (all bars of a run) and streaming
(bars as they close), so both give the same trades.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from typing import Any, NamedTuple


class Bar(NamedTuple):
    symbol: str
    asset_class: str
    k: int
    n: int
    ts: dt.datetime
    open: float
    high: float
    low: float
    close: float
    next_open: float | None
    htf_rows: int
    signal: tuple | None  # side, strategy, entry, stop, take_profit, conviction


@dataclass
class Position:
    side: str
    strategy: str
    asset_class: str
    qty: float
    entry: float
    stop: float
    target: float
    initial_stop: float
    best: float
    since: dt.datetime

    @property
    def sign(self) -> float:
        return 1.0 if self.side == "long" else -1.0

    def r_multiple(self, price: float) -> float:
        risk = abs(self.entry - self.initial_stop)
        return self.sign * (price - self.entry) / risk if risk > 0 else 0.0


@dataclass
class Simulator:
    """State of one run.  events collects (kind, ...) dicts: trade, equity and reject."""

    cfg: dict[str, Any]
    fill_mode: str = "parity"
    positions: dict[str, Position] = field(default_factory=dict)
    pending: dict[str, tuple] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)
    realised: float = 0.0
    day: Any = None
    week: Any = None
    day_start: float = 0.0
    week_start: float = 0.0
    daily_halt: bool = False
    weekly_halt: bool = False
    seq: int = 0

    def __post_init__(self) -> None:
        self.start = self.equity = self.peak = float(self.cfg["backtest"]["equity"])
        self.cluster = {}
        for k, own in enumerate(self.cfg["clusters"]):
            for s in own:
                self.cluster.setdefault(s, k)

    def step(self, b: Bar) -> None:
        c = self.cfg["backtest"]
        if b.k == b.n - 1:
            self.marks[b.symbol] = b.close
            if b.symbol in self.positions:
                self._close(b.symbol, b.close, b.ts, "end_of_data")
            self.pending.pop(b.symbol, None)
            return
        if b.k < c["warmup"]:
            return
        if b.symbol in self.pending:
            self._fill(b, self.pending.pop(b.symbol))
        if b.symbol in self.positions:
            self._manage(b)
        self._mark(b)
        if not (self.daily_halt or self.weekly_halt) and b.symbol not in self.pending and b.htf_rows >= c["min_htf"] and b.signal is not None:
            reason, qty = self.approve(b, b.signal)
            if reason:
                self.events.append({"kind": "reject", "symbol": b.symbol, "ts": b.ts, "side": b.signal[0], "strategy": b.signal[1], "reason": reason})
            else:
                self.pending[b.symbol] = (*b.signal, qty)

    def _fill(self, b: Bar, plan: tuple) -> None:
        side, strategy, _, stop, target, _, qty = plan
        sign = 1.0 if side == "long" else -1.0
        base = b.open if self.fill_mode == "next_open" else b.next_open
        fill = base * (1.0 + sign * self.cfg["backtest"]["slippage_bps"] / 1e4)
        if sign * (fill - stop) > 0:
            self.positions[b.symbol] = Position(side, strategy, b.asset_class, qty, fill, stop, target, stop, fill, b.ts)

    def _manage(self, b: Bar) -> None:
        p, c = self.positions[b.symbol], self.cfg["risk"]
        p.best = max(p.best, b.close) if p.side == "long" else min(p.best, b.close)
        if p.r_multiple(b.close) >= c["trail_activate_r"]:
            trail = p.best - p.sign * c["trail_mult"] * abs(p.entry - p.initial_stop)
            if p.sign * (trail - p.stop) > 0:
                p.stop = trail
        against, along = (b.low, b.high) if p.side == "long" else (b.high, b.low)
        if p.sign * (against - p.stop) <= 0:
            self._close(b.symbol, p.stop, b.ts, "stop")
        elif p.sign * (along - p.target) >= 0:
            self._close(b.symbol, p.target, b.ts, "take_profit")

    def _close(self, symbol: str, price: float, ts: dt.datetime, reason: str) -> None:
        p = self.positions.pop(symbol)
        fees = price * p.qty * self.cfg["backtest"]["fee_bps"] / 1e4
        pnl = p.sign * (price - p.entry) * p.qty - fees
        self.realised += pnl
        self.events.append({
            "kind": "trade", "symbol": symbol, "ts": ts, "side": p.side, "strategy": p.strategy, "entry_time": p.since, "entry_price": p.entry, "exit_price": price, "qty": p.qty,
            "pnl": pnl, "pnl_pct": pnl / (p.entry * p.qty) if p.qty else 0.0, "r_multiple": p.r_multiple(price), "reason": reason, "fees": fees, "seq": self.seq,
        })
        self.seq += 1

    def _mark(self, b: Bar) -> None:
        """Equity at the close, then new periods, then halts."""
        self.marks[b.symbol] = b.close
        self.equity = self.start + self.realised + sum(p.sign * (self.marks[s] - p.entry) * p.qty for s, p in self.positions.items())
        self.events.append({"kind": "equity", "symbol": b.symbol, "ts": b.ts, "equity": self.equity, "seq": self.seq})
        self.peak = max(self.peak, self.equity)
        day, week = b.ts.date(), tuple(b.ts.isocalendar()[:2])
        if day != self.day:
            self.day, self.day_start, self.daily_halt = day, self.equity, False
        if week != self.week:
            self.week, self.week_start, self.weekly_halt = week, self.equity, False
        c = self.cfg["risk"]
        self.daily_halt |= self.day_start > 0 and (self.day_start - self.equity) / self.day_start >= c["daily_halt"]
        self.weekly_halt |= self.week_start > 0 and (self.week_start - self.equity) / self.week_start >= c["weekly_halt"]

    def approve(self, b: Bar, signal: tuple) -> tuple[str | None, float]:
        """The first gate that fails and the quantity."""
        side, _, entry, stop, target, conviction = signal
        c = self.cfg["risk"]
        dist = abs(entry - stop)
        mult = c["conviction_min"] + (c["conviction_max"] - c["conviction_min"]) * conviction
        qty = min(c["risk_pct"] * self.equity * mult / dist, self.equity / entry) if dist > 0 else 0.0
        cap = self.cfg["class_caps"].get(b.asset_class, math.inf)
        own = self.cluster.get(b.symbol)
        checks = (
            ("weekly_halt", self.weekly_halt), ("daily_halt", self.daily_halt), ("already_open", b.symbol in self.positions), ("max_positions", len(self.positions) >= c["max_positions"]),
            ("reward_risk", (abs(target - entry) / dist if dist > 0 else 0.0) < c["min_rr"]), ("stop_side", stop >= entry if side == "long" else stop <= entry),
            ("cluster", own is not None and any(s != b.symbol and self.cluster.get(s) == own for s in self.positions)), ("class_cap", sum(p.asset_class == b.asset_class for p in self.positions.values()) >= cap), ("qty", qty <= 0),
        )
        return next((name for name, failed in checks if failed), None), qty


def event_frame(events: list[dict], run_id: str, schema: str):  # noqa: ANN201
    """Events of a run as a frame of the schema; what an event lacks is missing, whatever the other events have."""
    import pandas as pd

    kinds = {"double": "float64", "timestamp_ntz": "datetime64[ns]"}
    fields = [f.split() for f in schema.split(", ")]
    return pd.DataFrame({name: pd.Series([run_id if name == "run_id" else e.get(name) for e in events], dtype=kinds.get(kind, "object")) for name, kind in fields})

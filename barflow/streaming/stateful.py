"""Keyed state and event-time timers: rows that wait until the watermark settles them.

A row whose outcome depends on others of its time waits in map state, packed
with those of its cell (of time, or of orders).  Each key has one timer, at the
earliest time at which one of its rows may be settled; when the watermark
passes it, the cells that are due are settled some at a time, what no later row
needs is dropped, and the timer is set anew.  So a task holds some cells, never
all that waits under its key.  State lies in RocksDB (the session's own provider, if it has set one that is not the
default), is checkpointed with the query, and stays as small as what waits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Waiting rows are texts, with times to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Keys among which orders are dealt by their id.
BUCKETS = 64


def _millis(micros):  # noqa: ANN001, ANN202
    """The first millisecond that is not before the time: watermarks count in them."""
    out = -(-micros // 1000)
    return out if hasattr(out, "dtype") and getattr(out, "ndim", 0) else int(out)


#: Rows that a task gathers before it packs them by cells or settles them.
HELD_ROWS = 1 << 16


class Waiting(StatefulProcessor):
    """Rows of a key wait by cells in map state; settle says which are done."""

    #: Schema of a waiting row.
    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        import pyarrow as pa

        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        self.handle = handle
        self.columns = [c.split()[0] for c in self.schema.split(", ")]
        self.packed = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in self.schema.split(", "))])
        self.cells = handle.getMapState("cells", "cell long, part long, due long, n long", "rows binary")
        self.kept = handle.getValueState("kept", self.schema)
        self.timer = handle.getValueState("timer", "at long, parts long")

    def cell(self, rows: pd.DataFrame) -> pd.Series:
        """The cell of each row: rows of one are settled together, lower cells first."""
        raise NotImplementedError

    def first_due(self, rows: pd.DataFrame) -> int | None:
        """The earliest time, in milliseconds, at which one of new rows may be settled."""
        raise NotImplementedError

    def settle(self, rows: pd.DataFrame, watermark: int, kept: tuple | None) -> tuple[pd.DataFrame, pd.DataFrame, int | None, tuple | None]:
        """What comes out of some cells, the rows that still wait, when to look at them again, and the row that goes on to later cells."""
        raise NotImplementedError

    def _pack(self, rows: pd.DataFrame, due: int | None, parts: int) -> tuple[int | None, int]:
        """Rows into state by cells, due at a known time or by first_due; the earliest of these times and the parts numbered so far."""
        import pyarrow as pa

        first = None
        for cell, own in rows.groupby(self.cell(rows), sort=False):
            at = self.first_due(own) if due is None else due
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.packed) as out:
                out.write_table(pa.Table.from_pandas(own[self.columns], schema=self.packed, preserve_index=False))
            self.cells.updateValue((int(cell), parts, at, len(own)), (sink.getvalue().to_pybytes(),))
            first, parts = at if first is None else min(first, at), parts + 1
        return first, parts

    def _unpack(self, keys: list[tuple]) -> pd.DataFrame:
        import pandas as pd
        import pyarrow as pa

        return pd.concat([pa.ipc.open_stream(self.cells.getValue(k)[0]).read_pandas() for k in keys], ignore_index=True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        import pandas as pd

        set_at, parts = self.timer.get() if self.timer.exists() else (None, 0)
        first, held, n = None, [], 0

        def flush() -> None:
            nonlocal first, parts, held, n
            if held:
                at, parts = self._pack(pd.concat(held, ignore_index=True), None, parts)
                first, held, n = at if first is None else min(first, at), [], 0

        for frame in rows:
            held.append(frame[self.columns])
            n += len(frame)
            if n >= HELD_ROWS:
                flush()
        flush()
        if first is not None and (set_at is None or first < set_at):
            if set_at is not None:
                self.handle.deleteTimer(set_at)
            self.handle.registerTimer(first)
            set_at = first
        self.timer.update((set_at, parts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        parts = self.timer.get()[1]
        kept = tuple(self.kept.get()) if self.kept.exists() else None
        cells: dict[int, list[tuple]] = {}
        for k in sorted(tuple(k) for k in self.cells.keys()):
            cells.setdefault(k[0], []).append(k)
        next_at, taken, n = [], [], 0
        order = list(cells)
        for cell in order:
            own = cells[cell]
            if min(k[2] for k in own) > watermark:
                next_at.append(min(k[2] for k in own))
            else:
                taken += own
                n += sum(k[3] for k in own)
            if taken and (n >= HELD_ROWS or cell == order[-1]):
                out, rest, again, kept = self.settle(self._unpack(taken), watermark, kept)
                for k in taken:
                    self.cells.removeKey(k)
                if len(rest):
                    parts = self._pack(rest, again, parts)[1]
                    next_at.append(again)
                taken, n = [], 0
                if len(out):
                    out = out.assign(**dict(zip(self.keys, key, strict=True)))[self.out]
                    # a text that is missing everywhere must still be a column of texts
                    yield out.assign(**{c: out[c].astype(object).where(out[c].notna(), None) for c in self.texts})
        if kept is not None:
            self.kept.update(kept)
        if next_at:
            self.handle.registerTimer(min(next_at))
            self.timer.update((min(next_at), parts))
        else:
            self.timer.clear()

    def close(self) -> None:
        pass


def stateful(df: DataFrame, keys: list[str], processor: Waiting, out: str) -> DataFrame:
    """The stream through the processor, its state in RocksDB."""
    spark = df.sparkSession
    if not spark.conf.get(PROVIDER).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)
    columns = [c.split() for c in out.split(", ")]
    processor.keys, processor.out, processor.texts = keys, [c for c, _ in columns], [c for c, t in columns if t == "string"]
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


class AsOf(Waiting):
    """Left rows (side 1) wait for the watermark, then take the last right row (side 0) at or before them; one right row a key is kept beyond."""

    schema = "side int, at long, row string"

    def __init__(self, cell_s: int = 6 * 3600):
        self.width = cell_s * 1_000_000

    def cell(self, rows):  # noqa: ANN001, ANN201
        return rows["at"] // self.width

    def first_due(self, rows):  # noqa: ANN001, ANN201
        return _millis(rows["at"].min())

    def settle(self, rows, watermark, kept):  # noqa: ANN001, ANN201
        rows = rows.sort_values(["at", "side"], kind="stable")
        done = _millis(rows["at"]) <= watermark
        past = rows[done]
        right = past["row"].where(past["side"] == 0).ffill()
        if kept is not None:
            right = right.fillna(kept[2])
        out = past.assign(right=right)[past["side"] == 1]
        last = past[past["side"] == 0].tail(1)
        if len(last):
            kept = (0, int(last["at"].iloc[0]), last["row"].iloc[0])
        rest = rows[~done]
        return out[["row", "right"]].rename(columns={"row": "left"}), rest, _millis(rest["at"].min()) if len(rest) else None, kept


def asof_stream(left: DataFrame, right: DataFrame, by: str, on: str, delay: str = "0 seconds") -> DataFrame:
    """`operators.asof.asof_backward` over two streams: each left row once, when the watermark has passed its time, with the last right row.

    Both have a timestamp column `on`; of right rows with one key and time any
    may be taken; rows later than the watermark are dropped, as ever.
    """
    packed = lambda df, side: df.select(by, F.col(on).alias("_event"), F.lit(side).alias("side"), F.unix_micros(on).alias("at"), F.to_json(F.struct(*[c for c in df.columns if c != by]), TIMES).alias("row"))
    both = packed(right, 0).unionByName(packed(left, 1)).withWatermark("_event", delay)
    kind = dict(left.dtypes)[by]
    out = stateful(both, [by], AsOf(), f"{by} {kind}, left string, right string")
    schema = lambda df: ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != by)
    carried = [c for c in right.columns if c not in (by, on)]
    parts = out.select(by, F.from_json("left", schema(left), TIMES).alias("l"), F.from_json("right", schema(right), TIMES).alias("r"))
    return parts.select(*[F.col(by) if c == by else F.col("l")[c].alias(c) for c in left.columns], *[F.col("r")[c].alias(c) for c in carried])


class Orders(Waiting):
    """Entries and their fills, by buckets of orders; an entry is settled by its quote, its first fill or its timeout."""

    schema = "kind int, order_id long, side string, strategy string, bid double, ask double, at long"

    def __init__(self, timeout_s: float, fallback: list[str], bps: float):
        self.wait, self.fallback, self.bps = int(timeout_s * 1_000_000), fallback, bps

    def cell(self, rows):  # noqa: ANN001, ANN201
        import numpy as np

        # an order and its fills share a cell, one of sixteen
        return (rows["order_id"].to_numpy("int64").view("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype("int64")

    def _quoted(self, rows):  # noqa: ANN001, ANN202
        return (rows["bid"].fillna(0) > 0) & (rows["ask"].fillna(0) > 0)

    def first_due(self, rows):  # noqa: ANN001, ANN201
        later = (rows["kind"] == 0) & self._quoted(rows)
        return _millis((rows["at"] + later * self.wait).min())

    def settle(self, rows, watermark, kept):  # noqa: ANN001, ANN201
        import pandas as pd

        orders, fills = rows[rows["kind"] == 0].copy(), rows[rows["kind"] == 1]
        first = fills.groupby("order_id")["at"].min()
        fill = orders["order_id"].map(first)
        due, ok = orders["at"] + self.wait, self._quoted(orders)
        filled = ok & (fill <= due)
        orders["decided"] = orders["at"].where(~ok, fill.where(filled, due)).astype("int64")
        orders["outcome"] = pd.Series("cancelled", orders.index).mask(orders["strategy"].isin(self.fallback), "market").mask(filled, "filled").mask(~ok, "market")
        mid = ((orders["bid"] + orders["ask"]) / 2).where(ok)
        sign = orders["side"].map({"buy": -1.0}).fillna(1.0)
        orders["intended_price"] = mid * (1.0 + sign * self.bps / 1e4 * filled)
        done = _millis(orders["decided"]) <= watermark
        out = orders[done].assign(decided_ts=pd.to_datetime(orders["decided"][done], unit="us", utc=True))
        # a fill of no order waits for it as long as an order waits for a fill
        stray = fills[~fills["order_id"].isin(orders["order_id"])]
        stray = stray[_millis(stray["at"] + self.wait) > watermark]
        waits = fills[fills["order_id"].isin(orders["order_id"][~done])]
        times = [*orders["decided"][~done], *(stray["at"] + self.wait)]
        return out, pd.concat([orders[~done], waits, stray]), _millis(min(times)) if len(times) else None, None


def order_outcomes(signals: DataFrame, fills: DataFrame, timeout_s: float = 30, fallback: list[str] = ("momentum", "breakout"), bps: float = 2.0, delay: str = "0 seconds") -> DataFrame:
    """`operators.execution.entry_orders` over streams of entries (order_id, side, strategy, bid, ask, submit_ts) and fills (order_id, fill_ts).

    order_id, outcome, decided_ts and intended_price of each entry, once, when
    the watermark has passed its fill or its timeout.
    """
    none = {c: F.lit(None).cast(k) for c, k in (("side", "string"), ("strategy", "string"), ("bid", "double"), ("ask", "double"))}
    micros = lambda c: F.unix_micros(c).alias("at")
    entries = signals.select(F.col("submit_ts").alias("_event"), F.lit(0).alias("kind"), "order_id", "side", "strategy", "bid", "ask", micros("submit_ts"))
    filled = fills.select(F.col("fill_ts").alias("_event"), F.lit(1).alias("kind"), "order_id", *[c.alias(n) for n, c in none.items()], micros("fill_ts"))
    both = entries.unionByName(filled).withColumn("bucket", F.pmod(F.xxhash64("order_id"), F.lit(BUCKETS))).withWatermark("_event", delay)
    return stateful(both, ["bucket"], Orders(timeout_s, list(fallback), bps), "order_id long, outcome string, decided_ts timestamp, intended_price double")

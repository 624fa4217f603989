"""Series cut into blocks of rows, so that one key's history is the work of many tasks.

`blocked` numbers the rows of each key and cuts them into blocks of equal size,
if any key has more than a block; else the frame stays as it is and windows by
key do.  The numbers come from counts of time cells: only the counts, one row a
cell, meet in one window of a key.

On a blocked frame windows run by (key, block).  `haloed` adds to each block
the last n rows before it, so that frames of n rows and lags are whole; `own`
takes them away again.  `current` says by which columns the windows of column
builders run: `with over(df): ...`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Rows of one key that one task may hold; a key with more is cut into blocks.
BLOCK_ROWS = 1 << 20
#: Columns that a blocked frame has besides its own.
PLACE = ("_i", "_block", "_at", "_left")
_KEYS: ContextVar[tuple[str, ...]] = ContextVar("keys", default=("symbol",))


def is_blocked(df: DataFrame) -> bool:
    return "_block" in df.columns


def keys_of(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> tuple[str, ...]:
    return (*keys, "_block") if is_blocked(df) else tuple(keys)


@contextmanager
def over(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> Iterator[None]:
    """Column builders inside take windows that suit the frame."""
    token = _KEYS.set(keys_of(df, keys))
    try:
        yield
    finally:
        _KEYS.reset(token)


def current() -> tuple[str, ...]:
    return _KEYS.get()


def position(df: DataFrame, order: str) -> Column:
    """Times as microseconds, dates as days, numbers as they are."""
    kind = dict(df.dtypes)[order]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.unix_date(order) if kind == "date" else F.col(order).cast("double")


def same_keys(keys: Sequence[str], left: str, right: str) -> Column:
    """Null-safe equality of key columns under two aliases."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def cell_width(df: DataFrame, keys: Sequence[str], order: str, rows: int) -> float | None:
    """Width of cells that hold about `rows` rows of the densest key; None where no key has more rows."""
    p = position(df, order)
    each = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(p) - F.min(p) + 1).alias("span"))
    n, width = each.agg(F.max("n"), F.min(F.when(F.col("n") > rows, F.col("span") / F.col("n"))) * rows).first()
    return max(1.0, float(width or 1.0)) if (n or 0) > rows else None


def blocked(df: DataFrame, keys: Sequence[str] = ("symbol",), order: str | Sequence[str] = "ts", rows: int = BLOCK_ROWS) -> DataFrame:
    """df, or df with _i (its place, from 0), _block, _at (place in the block) and _left (rows to its end), kept in the shared folder."""
    order = [order] if isinstance(order, str) else list(order)
    width = cell_width(df, keys, order[0], rows)
    if width is None:
        return df
    celled = df.withColumn("_cell", F.floor(position(df, order[0]) / width))
    sizes = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_n")
    numbered = celled.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*order)) - 1)
    numbered = numbered.alias("a").join(sizes.alias("b"), same_keys([*keys, "_cell"], "a", "b"), "left").select("a.*", "b._before")
    place = numbered.withColumn("_i", F.col("_i") + F.col("_before")).drop("_cell", "_before")
    place = place.withColumns({"_block": F.floor(F.col("_i") / rows), "_at": F.col("_i") % rows})
    return cut(place.withColumn("_left", rows - 1 - F.col("_at")))


def haloed(df: DataFrame, n: int) -> DataFrame:
    """Each row also in the blocks whose first row it precedes by at most n rows; _own tells the rows of a block from its halo."""
    if not is_blocked(df):
        return df
    size = F.col("_at") + F.col("_left") + 1
    further = F.greatest(F.lit(0), F.ceil((n - F.col("_left")) / size))
    spread = df.withColumn("_to", F.explode(F.sequence(F.col("_block"), F.col("_block") + further)))
    return spread.withColumn("_own", F.col("_to") == F.col("_block")).drop("_block").withColumnRenamed("_to", "_block")


def own(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own") if "_own" in df.columns else df


def whole(df: DataFrame) -> DataFrame:
    """The frame without the columns of its blocks."""
    return df.drop(*PLACE, "_own")


def windowed(df: DataFrame, n: int, make: Callable[[], dict[str, Column]]) -> DataFrame:
    """df with columns whose windows reach back n rows at most; make builds them."""
    rows = haloed(df, n)
    with over(rows):
        return own(rows.withColumns(make()))


#: Running values: how rows are joined, and how a block's value goes with the one that enters it.
RUNNING: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda here, before: F.coalesce(here + before, here, before)),
    "max": (F.max, lambda here, before: F.greatest(here, before)),
    "min": (F.min, lambda here, before: F.least(here, before)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda here, before: F.coalesce(here, before)),
}


def running(df: DataFrame, values: dict[str, tuple[str, Column | str]], keys: Sequence[str] = ("symbol",), order: str | Sequence[str] = "ts") -> DataFrame:
    """df with running sums, maxima, minima or last values (name: kind, column) from each key's first row to the current one.

    On a blocked frame each block is summed up to one row, what enters a block
    comes from a window over these rows, and is joined to its rows.
    """
    order = [order] if isinstance(order, str) else list(order)
    source = df.withColumns({f"_v{k}": F.col(c) if isinstance(c, str) else c for k, (_, c) in enumerate(values.values())})
    so_far = Window.partitionBy(*keys_of(df, keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = source.withColumns({name: RUNNING[kind][0](f"_v{k}").over(so_far) for k, (name, (kind, _)) in enumerate(values.items())})
    if not is_blocked(df):
        return rows.select(*df.columns, *[n for n in values if n not in df.columns])
    last = lambda k: F.max_by(f"_v{k}", F.when(F.col(f"_v{k}").isNotNull(), F.col("_i")))
    sums = source.groupBy(*keys, "_block").agg(*[(last(k) if kind == "last" else RUNNING[kind][0](f"_v{k}")).alias(f"_s{k}") for k, (kind, _) in enumerate(values.values())])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    enter = sums.select(*keys, "_block", *[RUNNING[kind][0](f"_s{k}").over(before).alias(f"_e{k}") for k, (kind, _) in enumerate(values.values())])
    joined = rows.alias("a").join(enter.alias("b"), same_keys([*keys, "_block"], "a", "b")).select("a.*", *[f"b._e{k}" for k in range(len(values))])
    joined = joined.withColumns({name: RUNNING[kind][1](F.col(name), F.col(f"_e{k}")) for k, (name, (kind, _)) in enumerate(values.items())})
    return joined.select(*df.columns, *[n for n in values if n not in df.columns])


def number(df: DataFrame, order: str = "ts") -> Column:
    """A row's place in its series, from 1."""
    return (F.col("_i") + 1) if is_blocked(df) else F.row_number().over(Window.partitionBy(*current()).orderBy(order))

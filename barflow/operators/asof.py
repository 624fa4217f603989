"""Backward as-of join: for each left row the last right row at or before it.

Both sides are stacked, right rows first at equal times, and the last right
row is carried forward by one ordered window, so it is one shuffle and one
sort however many right rows there are.  Where a key has more rows than a task
should hold, both sides are cut into cells of time: the window runs inside a
cell, and the right row that enters a cell comes from the last ones of the
cells before it, one small row a cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series


def asof_backward(left: DataFrame, right: DataFrame, by: str, on: str, rows: int | None = series.BLOCK_ROWS) -> DataFrame:
    """left with the columns of the last right row; rows: of one key that a task may hold (None: all of them, uncounted).

    A NULL key is a key like others; rows without a time stand before all
    others; of right rows with one key and time any may be taken.
    """
    carried = [c for c in right.columns if c not in (by, on)]
    a = left.withColumn("_right", F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType)).withColumn("_side", F.lit(1))
    b = right.select(by, on, F.struct(*carried).alias("_right"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    width = None if rows is None else series.cell_width(left.select(by, on).unionByName(right.select(by, on)), [by], on, rows)
    if width is None:
        w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
        return out.select(*left.columns, *[F.col("_right")[c].alias(c) for c in carried])
    celled = lambda df: df.withColumn("_cell", F.floor(series.position(df, on) / width))
    w = Window.partitionBy(by, "_cell").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = celled(both).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).filter("_side = 1")
    # NULL times, a cell of their own, go first and need an order for the last of their right rows
    time = F.coalesce(series.position(b, on).cast("double"), F.lit(float("-inf")))
    last = celled(b).groupBy(by, "_cell").agg(F.max_by("_right", time).alias("_right"))
    cells = last.unionByName(celled(left).select(by, "_cell").distinct(), allowMissingColumns=True).groupBy(by, "_cell").agg(F.first("_right", ignorenulls=True).alias("_right"))
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    enters = cells.select(by, "_cell", F.last("_right", ignorenulls=True).over(before).alias("_enters"))
    out = inside.alias("l").join(enters.alias("r"), series.same_keys([by, "_cell"], "l", "r")).select("l.*", "r._enters")
    out = out.withColumn("_right", F.coalesce("_right", "_enters"))
    return out.select(*left.columns, *[F.col("_right")[c].alias(c) for c in carried])

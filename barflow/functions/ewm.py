"""Exponentially weighted means over series with gaps, as a scan by doubling.

With x[t] the values that are there and g[t] the rows since the one before,
y[t] = (w y[t-1] + a x[t]) / (w + a), w = (1 - a)^g[t], started at the first
value: without gaps the usual (1 - a) y[t-1] + a x[t].  Rows without a value
repeat the last mean.  Each step is a map y -> C y + D of the mean before it,
and such maps compose.  Round k composes a value's map with that of the value
2^k before it (lags that ignore NULLs), until no product of factors counts in a
double: about ten rounds for the usual periods, as no factor exceeds 1 - a.
All rounds are lags over one window, so a set of means shuffles and sorts its
rows once and joins nothing.

On a blocked frame (functions.series) each block is scanned by itself.  What a
block does to the mean that enters it is one small row (C, D and the places of
its first and last value); these rows are composed by the same scan, and each
block's rows are finished with the mean that enters it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .series import is_blocked, same_keys

#: Weights below this add nothing to a double.
LEAST = 1e-19


@dataclass(frozen=True)
class Mean:
    """One average: the source column, its factor, the values it needs, and the name of the result."""

    source: str
    alpha: float
    needs: int
    name: str


def ema(source: str, period: int, name: str) -> Mean:
    return Mean(source, 2.0 / (period + 1), period, name)


def wilder(source: str, period: int, name: str) -> Mean:
    return Mean(source, 1.0 / period, period, name)


def _lag(c: str, step: int, keys: Sequence[str], order: str) -> Column:
    by = ", ".join(f"`{k}`" for k in keys)
    return F.expr(f"lag(`{c}`, {step}) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY `{order}`)")


def _scan(rows: DataFrame, maps: Sequence[tuple[str, str, float]], keys: Sequence[str], order: str) -> DataFrame:
    """Columns C and D (NULL where there is no value) composed with all before them; maps: C, D and a bound of the factors."""
    step = 1
    while going := [m for m in maps if m[2] ** step > LEAST]:
        sums = {d: F.col(d) + F.col(c) * F.coalesce(_lag(d, step, keys, order), F.lit(0.0)) for c, d, _ in going}
        products = {c: F.col(c) * F.coalesce(_lag(c, step, keys, order), F.lit(1.0)) for c in dict.fromkeys(c for c, _, _ in going)}
        rows = rows.withColumns({**sums, **products})
        step *= 2
    return rows


def _factors(gap: Column, alpha: float) -> tuple[Column, Column]:
    """Weights of the mean before and of a value so many rows after the last one."""
    w = F.pow(F.lit(1.0 - alpha), gap)
    return F.when(gap == 1, 1.0 - alpha).otherwise(w / (w + alpha)), F.when(gap == 1, alpha).otherwise(alpha / (w + alpha))


def ewm(df: DataFrame, means: Sequence[Mean], keys: Sequence[str] = ("symbol",), order: str = "ts") -> DataFrame:
    """df with a column for each mean, NULL before it has its values; a NULL or NaN is a missing value."""
    by = (*keys, "_block") if is_blocked(df) else tuple(keys)
    w = Window.partitionBy(*by).orderBy(order)
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    sources = {s: k for k, s in enumerate(dict.fromkeys(m.source for m in means))}
    shared = {sa: k for k, sa in enumerate(dict.fromkeys((m.source, m.alpha) for m in means))}
    rows = df.withColumns({**{f"_x{k}": F.nanvl(F.col(s).cast("double"), F.lit(None)) for s, k in sources.items()}, "_t": F.col("_i") if is_blocked(df) else F.row_number().over(w)})
    rows = rows.withColumns({**{f"_n{k}": F.count(f"_x{k}").over(so_far) for k in sources.values()}, **{f"_p{k}": F.max(F.when(F.col(f"_x{k}").isNotNull(), F.col("_t"))).over(earlier) for k in sources.values()}})

    def here(k: int, first: Column, later: Column) -> Column:
        """Columns of a value: of a block's first one, of later ones, NULL where there is none."""
        return F.when(F.col(f"_x{k}").isNull(), None).when(F.col(f"_p{k}").isNull(), first).otherwise(later)

    maps = {f"_c{j}": here(sources[s], F.lit(1.0), _factors(F.col("_t") - F.col(f"_p{sources[s]}"), a)[0]) for (s, a), j in shared.items()}
    for k, m in enumerate(means):
        s = sources[m.source]
        maps[f"_y{k}"] = here(s, F.col(f"_x{s}"), F.col(f"_x{s}") * _factors(F.col("_t") - F.col(f"_p{s}"), m.alpha)[1])
    rows = rows.withColumns(maps)
    rows = _scan(rows, [(f"_c{shared[m.source, m.alpha]}", f"_y{k}", 1.0 - m.alpha) for k, m in enumerate(means)], by, order)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    rows = rows.withColumns({f"_y{k}": last(f"_y{k}") for k in range(len(means))})
    if is_blocked(df):
        rows = rows.withColumns({f"_c{j}": last(f"_c{j}") for j in shared.values()})
        rows = _carried(cut(rows), means, sources, shared, keys)
    rows = rows.withColumns({m.name: F.when(F.col(f"_n{sources[m.source]}") >= m.needs, F.col(f"_y{k}")) for k, m in enumerate(means)})
    return rows.select(*df.columns, *[m.name for m in means if m.name not in df.columns])


def _carried(rows: DataFrame, means: Sequence[Mean], sources: dict[str, int], shared: dict[tuple[str, float], int], keys: Sequence[str]) -> DataFrame:
    """Blocks' means (_y, _c with the first value of a block as the start, _n) as they are with what goes before the block."""
    edge = {}
    for k in sources.values():
        there = F.when(F.col(f"_x{k}").isNotNull(), F.col("_t"))
        edge |= {f"_first{k}": F.min(there), f"_last{k}": F.max(there), f"_x0{k}": F.min_by(f"_x{k}", there), f"_m{k}": F.count(f"_x{k}")}
    ends = {f"_{e}": F.max_by(f"_{c}", "_t") for e, c in [*[(f"r{j}", f"c{j}") for j in shared.values()], *[(f"l{k}", f"y{k}") for k in range(len(means))]]}
    blocks = rows.groupBy(*keys, "_block").agg(*[c.alias(n) for n, c in {**edge, **ends}.items()])
    w = Window.partitionBy(*keys).orderBy("_block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_p{k}": F.max(f"_last{k}").over(before) for k in sources.values()})

    def enters(k: int, alpha: float) -> tuple[Column, Column]:
        return _factors(F.col(f"_first{k}") - F.col(f"_p{k}"), alpha)

    maps = {}
    for (s, a), j in shared.items():
        k = sources[s]
        maps[f"_a{j}"] = F.when(F.col(f"_p{k}").isNull(), F.col(f"_r{j}")).otherwise(F.col(f"_r{j}") * enters(k, a)[0])
    for k, m in enumerate(means):
        s, j = sources[m.source], shared[m.source, m.alpha]
        start = F.col(f"_x0{s}") * (enters(s, m.alpha)[1] - 1.0)
        maps[f"_b{k}"] = F.when(F.col(f"_p{s}").isNull(), F.col(f"_l{k}")).otherwise(F.col(f"_l{k}") + F.col(f"_r{j}") * start)
    some = {c: F.when(F.col(f"_m{sources[means[int(c[2:])].source]}") > 0, e) if c.startswith("_b") else e for c, e in maps.items()}
    blocks = _scan(blocks.withColumns(some), [(f"_a{shared[m.source, m.alpha]}", f"_b{k}", 1.0 - m.alpha) for k, m in enumerate(means)], keys, "_block")
    into = {f"_in{k}": F.last(f"_b{k}", ignorenulls=True).over(before) for k in range(len(means))}
    seen = {f"_seen{k}": F.coalesce(F.sum(f"_m{k}").over(before), F.lit(0)) for k in sources.values()}
    blocks = blocks.withColumns({**into, **seen, **{f"_w{j}": enters(sources[s], a)[0] for (s, a), j in shared.items()}, **{f"_v{j}": enters(sources[s], a)[1] for (s, a), j in shared.items()}})
    blocks = blocks.select(*keys, "_block", *into, *seen, *[f"_x0{k}" for k in sources.values()], *[f"_{c}{j}" for j in shared.values() for c in "wv"])
    joined = rows.alias("a").join(blocks.alias("b"), same_keys([*keys, "_block"], "a", "b")).select("a.*", *[f"b.{c}" for c in blocks.columns if c not in (*keys, "_block")])
    whole = {}
    for k, m in enumerate(means):
        s, j = sources[m.source], shared[m.source, m.alpha]
        start = F.col(f"_w{j}") * F.col(f"_in{k}") + F.col(f"_x0{s}") * (F.col(f"_v{j}") - 1.0)
        whole[f"_y{k}"] = F.when(F.col(f"_in{k}").isNull(), F.col(f"_y{k}")).when(F.col(f"_n{s}") == 0, F.col(f"_in{k}")).otherwise(F.col(f"_y{k}") + F.col(f"_c{j}") * start)
    return joined.withColumns({**whole, **{f"_n{k}": F.col(f"_n{k}") + F.col(f"_seen{k}") for k in sources.values()}})

"""Target weights from scores: same-date top-k selection, water-filling caps, group
caps and factor exposure bounds. All but several simultaneous bounds are windows over
the date, so a book of any size is planned as one exchange by date."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.panel import day, strict_number

TOLERANCE = 1e-12


@dataclass(frozen=True)
class ExposureBound:
    column: str
    minimum: float | None = None
    maximum: float | None = None

    def __post_init__(self):
        if self.minimum is None and self.maximum is None:
            raise ValueError("a bound needs a minimum or a maximum")
        if (self.minimum or 0) > 0 or (self.maximum or 0) < 0:
            raise ValueError("bounds must hold zero: minimum <= 0 <= maximum")


def _pick(score: Column, descending: bool, among: Column) -> Column:
    """1, 2, .. by score, ties by symbol, among some rows of the date."""
    order = score.desc() if descending else score.asc()
    return F.when(among, F.row_number().over(Window.partitionBy("date", among).orderBy(order, F.col("symbol").asc())))


def _side(df: DataFrame, chosen: str, score: Column, weighting: str, exposure: float, cap: Column | None, long: bool, output: str) -> DataFrame:
    """Positive weights of one side that sum to the exposure, or less where caps bind.

    With caps, w = min(cap, k * strength): rows are ordered by cap / strength, and k is
    (exposure - caps before) / (strengths from here on) at the first row whose cap it
    does not pass."""
    c = F.col(chosen)
    w = Window.partitionBy("date", c)
    if weighting == "equal":
        s = F.lit(1.0)
    elif weighting == "score":
        s = score - F.min(score).over(w) + 1 if long else F.max(score).over(w) - score + 1
    else:
        raise ValueError("weighting is equal or score")
    df = df.withColumn("__s", F.when(c, s))
    if cap is None:
        return df.withColumn(output, F.when(c, exposure * F.col("__s") / F.sum("__s").over(w)).otherwise(0.0)).drop("__s")
    df = df.withColumn("__cap", F.greatest(F.coalesce(cap, F.lit(0.0)), F.lit(0.0))).withColumn("__q", F.col("__cap") / F.col("__s"))
    order = w.orderBy("__q", "symbol")
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("__s").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumns({"__k": F.when(c, (exposure - before) / onward), "__o": F.row_number().over(order)})
    fits = F.when(F.col("__k") <= F.col("__q"), F.struct("__o", "__k"))
    df = df.withColumn("__lam", F.min(fits).over(w)["__k"])
    weight = F.when(F.col("__lam").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.greatest(F.col("__lam"), F.lit(0.0)) * F.col("__s")))
    return df.withColumn(output, F.when(c, weight).otherwise(0.0)).drop("__s", "__cap", "__q", "__k", "__o", "__lam")


def _group_cap(df: DataFrame, weight: str, group: str, cap: float) -> DataFrame:
    """Groups over the cap are scaled down to it; rows without a label get nothing."""
    g = F.nullif(F.trim(F.col(group).cast("string")), F.lit(""))
    total = F.sum(weight).over(Window.partitionBy("date", g))
    scale = F.when(total > cap, cap / total).otherwise(1.0)
    return df.withColumn(weight, F.when(g.isNotNull(), F.col(weight) * scale).otherwise(0.0))


def _one_bound(df: DataFrame, weight: str, bound: ExposureBound) -> DataFrame:
    """Shrinks what adds to an exposure beyond a bound, which one bound always reaches."""
    x, w = F.coalesce(strict_number(bound.column), F.lit(0.0)), day()
    df = df.withColumn(weight, F.when(strict_number(bound.column).isNotNull(), F.col(weight)).otherwise(0.0))
    for limit, sign in ((bound.maximum, 1), (bound.minimum, -1)):
        if limit is None:
            continue
        df = df.withColumn("__e", sign * F.col(weight) * x)
        over = F.sum("__e").over(w) - sign * limit
        adding = F.sum(F.when(F.col("__e") > 0, F.col("__e")).otherwise(0.0)).over(w)
        df = df.withColumns({"__over": over, "__add": adding})
        shrink = F.when((F.col("__over") > TOLERANCE) & (F.col("__e") > 0), 1 - F.least(F.lit(1.0), F.col("__over") / F.col("__add"))).otherwise(1.0)
        df = df.withColumn(weight, F.col(weight) * shrink).drop("__e", "__over", "__add")
    return df


def _many_bounds(df: DataFrame, weight: str, bounds: list[ExposureBound]) -> DataFrame:
    """Sweeps over several bounds couple rows of a date in turns: a grouped map by date."""
    df = df.withColumns({f"__x{i}": strict_number(b.column) for i, b in enumerate(bounds)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        w = g[weight].to_numpy(float).copy()
        xs = [g[f"__x{i}"].to_numpy(float) for i in range(len(bounds))]
        for x in xs:
            w[~np.isfinite(x)] = 0.0
        xs = [np.nan_to_num(x) for x in xs]
        for _ in range(4 * len(bounds)):
            moved = False
            for b, x in zip(bounds, xs, strict=True):
                for limit, sign in ((b.maximum, 1), (b.minimum, -1)):
                    e = sign * w * x
                    over = e.sum() - sign * limit if limit is not None else 0.0
                    if over > TOLERANCE:
                        w[e > 0] *= 1 - min(1.0, over / e[e > 0].sum())
                        moved = True
            if not moved:
                break
        for b, x in zip(bounds, xs, strict=True):
            e = (w * x).sum()
            if (b.maximum is not None and e > b.maximum + TOLERANCE) or (b.minimum is not None and e < b.minimum - TOLERANCE):
                w[:] = 0.0
        return g.assign(**{weight: w})

    return df.groupBy("date").applyInPandas(run, schema).drop(*[f"__x{i}" for i in range(len(bounds))])


def _finish(df, weight, group, group_cap, bounds):
    if group is not None:
        df = _group_cap(df, weight, group, group_cap)
    if bounds:
        df = _one_bound(df, weight, bounds[0]) if len(bounds) == 1 else _many_bounds(df, weight, list(bounds))
    return df


def _cap(max_weight: float | None, cap_column: str | None) -> Column | None:
    """The cap of a row: missing is 0; what is negative or no number is an error."""
    if max_weight is not None and not 0 < max_weight < float("inf"):
        raise ValueError("a position cap must be positive and finite")
    if cap_column is None:
        return None if max_weight is None else F.lit(float(max_weight))
    x = F.expr(f"try_cast(`{cap_column}` AS double)")
    bad = (F.col(cap_column).isNotNull() & x.isNull()) | (x < 0)
    own = F.when(bad, F.raise_error(F.lit(f"negative or invalid cap in {cap_column}")).cast("double")).otherwise(F.when(~F.isnan(x), x).otherwise(0.0))
    return own if max_weight is None else F.least(F.lit(float(max_weight)), own)


def _checked(exposures: list[float], top: list[int], max_weight, group, group_cap) -> None:
    if any(not 0 < e < float("inf") for e in exposures) or any(n < 1 for n in top):
        raise ValueError("exposures must be positive and finite, counts at least 1")
    if (group is None) != (group_cap is None):
        raise ValueError("a group cap needs a group column, and the reverse")
    for limit in (max_weight, group_cap):
        if limit is not None and not 0 < limit <= min(exposures):
            raise ValueError("caps must be positive and not above the exposure")


def long_only(df, score, top_n, weighting="equal", exposure=1.0, max_weight=None, cap_column=None, group=None, group_cap=None, bounds=(), output="portfolio_weight") -> DataFrame:
    """The top_n scores of each date (ties by symbol; fewer is fine); others weigh 0."""
    _checked([exposure], [top_n], max_weight, group, group_cap)
    x = F.col(score)
    df = df.withColumn("__pick", F.coalesce(_pick(x, True, x.isNotNull()) <= top_n, F.lit(False)))
    df = _side(df, "__pick", x, weighting, exposure, _cap(max_weight, cap_column), True, output).drop("__pick")
    return _finish(df, output, group, group_cap, bounds)


def long_short(df, score, top_n, bottom_n, weighting="equal", long_exposure=1.0, short_exposure=1.0, max_weight=None, cap_column=None, group=None, group_cap=None, bounds=(), output="portfolio_weight") -> DataFrame:
    """Longs by score from the top, shorts from the bottom of the rest; a date with
    fewer than top_n + bottom_n scores is empty."""
    _checked([long_exposure, short_exposure], [top_n, bottom_n], max_weight, group, group_cap)
    x, cap = F.col(score), _cap(max_weight, cap_column)
    enough = F.count(x).over(day()) >= top_n + bottom_n
    df = df.withColumn("__pick", F.coalesce((_pick(x, True, x.isNotNull()) <= top_n) & enough, F.lit(False)))
    df = df.withColumn("__rest", x.isNotNull() & ~F.col("__pick"))
    df = df.withColumn("__s2", F.coalesce((_pick(x, False, F.col("__rest")) <= bottom_n) & enough, F.lit(False))).drop("__rest")
    df = _side(df, "__pick", x, weighting, long_exposure, cap, True, "__wl")
    df = _side(df, "__s2", x, weighting, short_exposure, cap, False, "__ws")
    if group is not None:
        df = _group_cap(_group_cap(df, "__wl", group, group_cap), "__ws", group, group_cap)
    df = df.withColumn(output, F.col("__wl") - F.col("__ws")).drop("__wl", "__ws", "__pick", "__s2")
    return _finish(df, output, None, None, bounds)

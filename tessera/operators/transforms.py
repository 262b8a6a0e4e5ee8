"""Same-date transforms of a signal. Output: {score}_{suffix}, so chains name themselves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.panel import add, clip, day, strict_number


def _group(group: str | None):
    return day(*([group] if group else []))


def _named(x: Column, group: str | None) -> Column:
    """A row without a group label gets nothing; a window would make NULL a group."""
    return x if group is None else F.when(F.col(group).isNotNull(), x)


def winsorize(df: DataFrame, score: str, quantile: float = 0.05) -> DataFrame:
    if not 0 <= quantile < 0.5:
        raise ValueError("quantile must be in [0, 0.5)")
    x = F.col(score)
    if quantile == 0:
        return add(df, **{f"{score}_winsorized": x})
    q = lambda p: F.percentile(x, F.lit(p)).over(day())
    return add(df, **{f"{score}_winsorized": clip(x, q(quantile), q(1 - quantile))})


def clipped(df: DataFrame, score: str, lower: float, upper: float) -> DataFrame:
    if lower > upper:
        raise ValueError("lower must not exceed upper")
    return add(df, **{f"{score}_clipped": clip(F.col(score), F.lit(float(lower)), F.lit(float(upper)))})


def demean(df: DataFrame, score: str, group: str | None = None) -> DataFrame:
    x, w = F.col(score), _group(group)
    return add(df, **{f"{score}_demeaned": _named(F.when(F.count(x).over(w) >= 2, x - F.avg(x).over(w)), group)})


def zscore(df: DataFrame, score: str, group: str | None = None) -> DataFrame:
    x, w = F.col(score), _group(group)
    sd = F.stddev_pop(x).over(w)
    return add(df, **{f"{score}_zscore": _named(F.when((F.count(x).over(w) >= 2) & (sd > 0), (x - F.avg(x).over(w)) / sd), group)})


def robust_zscore(df: DataFrame, score: str, group: str | None = None) -> DataFrame:
    x, w = F.col(score), _group(group)
    df = df.withColumn("__m", F.median(x).over(w)).withColumn("__a", F.abs(x - F.col("__m")))
    mad = F.median("__a").over(w)
    out = add(df, **{f"{score}_robust_zscore": _named(F.when((F.count(x).over(w) >= 2) & (mad > 0), (x - F.col("__m")) / (1.4826 * mad)), group)})
    return out.drop("__m", "__a")


def average_rank(x: Column, keys: list[str]) -> Column:
    """The average rank among rows that have x; use within when(x is not null)."""
    has = x.isNotNull()
    w = Window.partitionBy(*keys, has).orderBy(x)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, has, x)) - 1) / 2


def rank_normalize(df: DataFrame, score: str, group: str | None = None) -> DataFrame:
    x, keys = F.col(score), ["date", *([group] if group else [])]
    n = F.count(x).over(_group(group))
    return add(df, **{f"{score}_rank": _named(F.when(x.isNotNull() & (n >= 2), (average_rank(x, keys) - 1) / (n - 1)), group)})


def residualize(df: DataFrame, score: str, exposures: list[str]) -> DataFrame:
    """Residuals of a same-date regression with intercept over complete rows; a date
    needs k + 2 of them and full rank. One exposure is windowed moments; several are a
    grouped map by date, whose input is the date's cross-section."""
    name = f"{score}_residualized"
    if score in exposures or name in df.columns:
        raise ValueError("a score is no exposure of itself, and the output must be new")
    if len(exposures) == 1:
        e = strict_number(exposures[0])
        y, x = F.when(e.isNotNull(), F.col(score)), F.when(F.col(score).isNotNull(), e)
        w = day()
        beta = F.covar_samp(y, x).over(w) / F.var_samp(x).over(w)
        ok = (F.count(y).over(w) >= 3) & (F.var_samp(x).over(w) > 0) & y.isNotNull()
        return add(df, **{name: F.when(ok, y - F.avg(y).over(w) - F.when(F.var_samp(x).over(w) > 0, beta) * (x - F.avg(x).over(w)))})
    own = {f"__x{i}": strict_number(c) for i, c in enumerate(exposures)}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {c} double" for c in own) + f", `{name}` double"
    return df.withColumns(own).groupBy("date").applyInPandas(_regress(score, list(own), name), schema).drop(*own)


def _regress(score: str, exposures: list[str], name: str):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        y, x = g[score].to_numpy(float), g[exposures].to_numpy(float)
        ok = np.isfinite(y) & np.isfinite(x).all(1)
        out = np.full(len(g), np.nan)
        a = np.column_stack([np.ones(ok.sum()), x[ok]])
        if ok.sum() >= len(exposures) + 2 and np.linalg.matrix_rank(a) == a.shape[1]:
            out[ok] = y[ok] - a @ np.linalg.lstsq(a, y[ok], rcond=None)[0]
        return g.assign(**{name: pd.Series(out, g.index).where(ok)})

    return run


TRANSFORMS = {
    "winsorize": (winsorize, "winsorized"), "clip": (clipped, "clipped"), "residualize": (residualize, "residualized"), "demean": (demean, "demeaned"),
    "zscore": (zscore, "zscore"), "robust_zscore": (robust_zscore, "robust_zscore"), "rank": (rank_normalize, "rank"),
}


def apply_transforms(df: DataFrame, score: str, steps: list[tuple[str, dict]]) -> tuple[DataFrame, str]:
    """A chain of named transforms, each on the last one's output."""
    for name, options in steps:
        suffix = get_transform(name)["suffix"]
        df, score = TRANSFORMS[name][0](df, score, **options), f"{score}_{suffix}"
    return df, score


def get_transform(name: str) -> dict:
    """Name, suffix of the output's column and what the transform does."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}; known: {', '.join(TRANSFORMS)}")
    build, suffix = TRANSFORMS[name]
    return {"name": name, "suffix": suffix, "scope": "date", "description": " ".join((build.__doc__ or name).split())}


def list_transforms() -> list[dict]:
    return [get_transform(k) for k in TRANSFORMS]


def standard_steps(winsorize_quantile=None, clip_bounds=None, residualize_on=None, demean_group=None, normalization="none", group=None) -> list[tuple[str, dict, str]]:
    """Transform, options and suffix of each step in the fixed order: winsorize, clip,
    residualize, demean, normalise."""
    if group and normalization == "none":
        raise ValueError("a group needs a normalization")
    steps = []
    if winsorize_quantile is not None:
        steps.append(("winsorize", {"quantile": winsorize_quantile}))
    if clip_bounds is not None:
        steps.append(("clip", {"lower": clip_bounds[0], "upper": clip_bounds[1]}))
    if residualize_on:
        steps.append(("residualize", {"exposures": list(residualize_on)}))
    if demean_group:
        steps.append(("demean", {"group": demean_group}))
    if normalization != "none":
        steps.append((normalization, {"group": group}))
    return [(name, options, get_transform(name)["suffix"]) for name, options in steps]


def standard_transform(df, score, *settings, **named) -> tuple[DataFrame, str]:
    """The steps of :func:`standard_steps`, each on the last one's output."""
    return apply_transforms(df, score, [(name, options) for name, options, _ in standard_steps(*settings, **named)])

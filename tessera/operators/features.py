"""Rolling features and labels of a panel (date, symbol, open, high, low, close, volume).

Each function returns the panel with its columns; windows count rows of the symbol,
and a value is missing until its window is full. All share one window spec by
symbol, so Catalyst plans one exchange and one sort for a chain of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.panel import add, finite, full, positive_log, prior, ratio, rolling, sym

LN = lambda a, b: F.ln(F.col(a) / F.col(b))
DV = lambda: F.col("close") * F.col("volume")


def _window(n: int, least: int = 1) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < least:
        raise ValueError(f"window must be an integer of at least {least}")
    return n


def _mean(df: DataFrame, x: Column, n: int, window) -> tuple[DataFrame, Column]:
    """df with x in a scratch column (so its lags are not nested), and its full mean."""
    df = df.withColumn("__x", x)
    return df, full(F.avg("__x"), F.col("__x"), n, window(n))


def returns(df: DataFrame) -> DataFrame:
    df = add(df, daily_return=F.col("close") / F.lag("close").over(sym()) - 1)
    return add(df, log_return=F.log1p("daily_return"))


def forward_return(df: DataFrame, horizon: int = 1) -> DataFrame:
    return add(df, **{f"forward_return_{_window(horizon)}d": F.lead("close", horizon).over(sym()) / F.col("close") - 1})


def rolling_volatility(df: DataFrame, n: int = 20) -> DataFrame:
    return add(df, **{f"rolling_volatility_{_window(n)}d": full(F.stddev_samp("daily_return"), F.col("daily_return"), n, rolling(n))})


def average_volume(df: DataFrame, n: int = 20) -> DataFrame:
    return add(df, **{f"rolling_average_volume_{_window(n)}d": full(F.avg("volume"), F.col("volume"), n, rolling(n))})


def garman_klass(df: DataFrame, n: int) -> DataFrame:
    df, m = _mean(df, 0.5 * LN("high", "low") ** 2 - (2 * math.log(2) - 1) * LN("close", "open") ** 2, _window(n), rolling)
    return add(df, **{f"garman_klass_volatility_{n}d": F.when(m > 0, F.sqrt(m))}).drop("__x")


def parkinson(df: DataFrame, n: int) -> DataFrame:
    df, m = _mean(df, LN("high", "low") ** 2 / (4 * math.log(2)), _window(n), rolling)
    return add(df, **{f"parkinson_volatility_{n}d": F.sqrt(m)}).drop("__x")


def rogers_satchell(df: DataFrame, n: int) -> DataFrame:
    df, m = _mean(df, LN("high", "open") * LN("high", "close") + LN("low", "open") * LN("low", "close"), _window(n), rolling)
    return add(df, **{f"rogers_satchell_volatility_{n}d": F.when(m >= 0, F.sqrt(m))}).drop("__x")


def yang_zhang(df: DataFrame, n: int) -> DataFrame:
    _window(n, 2)
    df = df.withColumns({
        "__o": F.ln(F.col("open") / F.lag("close").over(sym())), "__c": LN("close", "open"),
        "__x": LN("high", "open") * LN("high", "close") + LN("low", "open") * LN("low", "close"),
    })
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    var = lambda c: full(F.var_samp(c), F.col(c), n, rolling(n))
    v = var("__o") + k * var("__c") + (1 - k) * full(F.avg("__x"), F.col("__x"), n, rolling(n))
    return add(df, **{f"yang_zhang_volatility_{n}d": F.when(v >= 0, F.sqrt(v))}).drop("__o", "__c", "__x")


def true_range() -> Column:
    pc = F.lag("close").over(sym())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def average_true_range(df: DataFrame, n: int) -> DataFrame:
    df, m = _mean(df, true_range(), _window(n), rolling)
    return add(df, **{f"average_true_range_{n}d": m}).drop("__x")


def normalized_average_true_range(df: DataFrame, n: int) -> DataFrame:
    df, m = _mean(df, true_range(), _window(n), rolling)
    return add(df, **{f"normalized_average_true_range_{n}d": m / F.col("close")}).drop("__x")


def amihud(df: DataFrame, n: int) -> DataFrame:
    df, m = _mean(df, F.when(DV() > 0, F.abs("daily_return") / DV()), _window(n), rolling)
    return add(df, **{f"amihud_illiquidity_{n}d": finite(m)}).drop("__x")


def _shock(df: DataFrame, x: Column, n: int, name: str) -> DataFrame:
    df, m = _mean(df, positive_log(x), _window(n), prior)
    return add(df, **{name: F.col("__x") - m}).drop("__x")


def dollar_volume_shock(df: DataFrame, n: int) -> DataFrame:
    return _shock(df, DV(), n, f"dollar_volume_shock_{n}d")


def volume_shock(df: DataFrame, n: int) -> DataFrame:
    return _shock(df, F.col("volume"), n, f"volume_shock_{n}d")


def dollar_volume_zscore(df: DataFrame, n: int) -> DataFrame:
    df, m = _mean(df, positive_log(DV()), _window(n, 2), prior)
    sd = full(F.stddev_samp("__x"), F.col("__x"), n, prior(n))
    return add(df, **{f"dollar_volume_zscore_{n}d": F.when(sd > 0, (F.col("__x") - m) / sd)}).drop("__x")


def _relative(df: DataFrame, x: Column, n: int, name: str) -> DataFrame:
    df, m = _mean(df, x, _window(n), prior)
    return add(df, **{name: F.when(m > 0, F.col("__x") / m)}).drop("__x")


def relative_volume(df: DataFrame, n: int) -> DataFrame:
    return _relative(df, F.col("volume"), n, f"relative_volume_{n}d")


def relative_dollar_volume(df: DataFrame, n: int) -> DataFrame:
    return _relative(df, DV(), n, f"relative_dollar_volume_{n}d")


def realized_family(df: DataFrame, n: int) -> DataFrame:
    _window(n)
    r = F.col("daily_return")
    parts = {"realized_volatility": r, "realized_downside_volatility": F.when(r.isNotNull(), F.least(r, F.lit(0.0))), "realized_upside_volatility": F.when(r.isNotNull(), F.greatest(r, F.lit(0.0)))}
    return add(df, **{f"{k}_{n}d": F.sqrt(full(F.avg(x * x), r, n, rolling(n))) for k, x in parts.items()})


def higher_moments(df: DataFrame, n: int) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis; a constant window gives 0 and -3."""
    _window(n, 4)
    r, w = F.col("daily_return"), rolling(n)
    same = F.max(r).over(w) == F.min(r).over(w)
    g1 = F.skewness(r).over(w) * math.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r).over(w) + 6)
    ok = F.count(r).over(w) == n
    return add(df, **{
        f"rolling_skewness_{n}d": F.when(ok, F.when(same, 0.0).otherwise(g1)),
        f"rolling_kurtosis_{n}d": F.when(ok, F.when(same, -3.0).otherwise(g2)),
    })


def with_benchmark(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """benchmark_return by date. One row a date: Spark broadcasts it while it is small."""
    return df.join(benchmark.select("date", "benchmark_return"), "date", "left")


def _pair(window) -> dict[str, Column]:
    """Moments of (daily_return, benchmark_return) over rows where both are there."""
    r = F.when(F.col("benchmark_return").isNotNull(), F.col("daily_return"))
    b = F.when(F.col("daily_return").isNotNull(), F.col("benchmark_return"))
    return {
        "n": F.count(r).over(window), "cov": F.covar_samp(r, b).over(window), "vr": F.var_samp(r).over(window), "vb": F.var_samp(b).over(window),
        "mr": F.avg(r).over(window), "mb": F.avg(b).over(window),
    }


def benchmark_statistics(df: DataFrame, n: int = 20) -> DataFrame:
    m = _pair(rolling(_window(n)))
    ok = m["n"] == n
    return add(df, **{
        f"rolling_benchmark_beta_{n}d": F.when(ok & (m["vb"] > 0), m["cov"] / m["vb"]),
        f"rolling_benchmark_correlation_{n}d": F.when(ok & (m["vb"] > 0) & (m["vr"] > 0), m["cov"] / F.sqrt(m["vb"]) / F.sqrt(m["vr"])),
    })


def benchmark_residual(df: DataFrame, n: int) -> DataFrame:
    """r - (alpha + beta b), alpha and beta from the n rows before."""
    m = _pair(prior(_window(n, 2)))
    beta = F.when((m["n"] == n) & (m["vb"] > 0), m["cov"] / m["vb"])
    return add(df, **{f"benchmark_residual_return_{n}d": F.col("daily_return") - (m["mr"] - beta * m["mb"] + beta * F.col("benchmark_return"))})


def momentum(df: DataFrame, n: int = 20) -> DataFrame:
    return add(df, **{f"momentum_signal_{_window(n)}d": F.col("close") / F.lag("close", n).over(sym()) - 1})


def mean_reversion(df: DataFrame, n: int = 5) -> DataFrame:
    return add(df, **{f"mean_reversion_signal_{_window(n)}d": -(F.col("close") / F.lag("close", n).over(sym()) - 1)})


def trend(df: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    if _window(short) >= _window(long):
        raise ValueError("the short window must be below the long one")
    sma = lambda n: full(F.avg("close"), F.col("close"), n, rolling(n))
    return add(df, **{f"trend_signal_{short}_{long}d": sma(short) / sma(long) - 1})


#: Factors by name: defaults and builder. An extension adds an entry.
FACTORS = {
    "momentum": ({"lookback": 1}, lambda df, p: momentum(df, p["lookback"]), "momentum_signal_{lookback}d"),
    "mean_reversion": ({"lookback": 1}, lambda df, p: mean_reversion(df, p["lookback"]), "mean_reversion_signal_{lookback}d"),
    "trend": ({"short": 20, "long": 60}, lambda df, p: trend(df, p["short"], p["long"]), "trend_signal_{short}_{long}d"),
}


def get_factor(name: str) -> dict:
    """Name, parameters with their defaults, and column of a factor."""
    key = name.strip().lower()
    if key not in FACTORS:
        raise ValueError(f"unknown factor {name}; known: {', '.join(FACTORS)}")
    return {"name": key, "parameters": dict(FACTORS[key][0]), "column": FACTORS[key][2]}


def list_factors() -> list[dict]:
    return [get_factor(k) for k in FACTORS]


def factor_signal(df: DataFrame, name: str, **parameters: int) -> tuple[DataFrame, str]:
    """The panel with a factor's signal, and the signal's column."""
    defaults, build, template = FACTORS[get_factor(name)["name"]]
    if set(parameters) - set(defaults):
        raise ValueError(f"{name} takes {', '.join(defaults)}")
    p = defaults | parameters
    return build(df, p), template.format(**p)


def guarded_ratio(df: DataFrame, name: str, numerator: str, denominator: str) -> DataFrame:
    """numerator / denominator, missing where the denominator is not positive."""
    return add(df, **{name: F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator))})


def price_ratio(df: DataFrame, fundamental: str, name: str) -> DataFrame:
    return add(df, **{name: ratio(F.col(fundamental), F.col("close"))})

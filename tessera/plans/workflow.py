"""From a TOML configuration to a panel, a signal, weights, a backtest and a report.

A section's keys and defaults are in ``SECTIONS``; an unknown key or section is an
error. Paths are relative to the file. The dataset is one lazy plan; a report keeps the
panel and the daily results in Spark's cache while its summaries are made.
"""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panel import add
from ..operators import analytics as A
from ..operators import asof as J
from ..operators import features as X
from ..operators import portfolio as P
from ..operators.backtest import BacktestSettings, attach_benchmark, run_backtest
from ..operators.transforms import standard_transform
from ..operators.universe import UniverseRules, apply_universe, mask_signal
from ..sinks import reports as R
from ..sources import tables as S


class ConfigError(ValueError):
    """A configuration file breaks a rule."""


BENCHMARK_WINDOW = 20
#: Window options of [dataset] and the feature each adds, in the order of the columns.
WINDOWS = {
    "average_true_range_window": X.average_true_range, "normalized_average_true_range_window": X.normalized_average_true_range,
    "amihud_illiquidity_window": X.amihud, "dollar_volume_shock_window": X.dollar_volume_shock, "dollar_volume_zscore_window": X.dollar_volume_zscore,
    "volume_shock_window": X.volume_shock, "relative_volume_window": X.relative_volume, "relative_dollar_volume_window": X.relative_dollar_volume,
    "garman_klass_volatility_window": X.garman_klass, "parkinson_volatility_window": X.parkinson, "rogers_satchell_volatility_window": X.rogers_satchell,
    "yang_zhang_volatility_window": X.yang_zhang, "realized_volatility_window": X.realized_family, "higher_moments_window": X.higher_moments,
}
#: Tables besides [data]: section -> options that name the input's columns.
TABLES = {
    "benchmark": {"return_column": "benchmark_return"},
    "calendar": {"date_column": "date"},
    "symbol_metadata": {"listing_date_column": "listing_date", "delisting_date_column": "delisting_date"},
    "corporate_actions": {"ex_date_column": "ex_date", "action_type_column": "action_type", "split_ratio_column": "split_ratio", "cash_amount_column": "cash_amount"},
    "fundamentals": {"period_end_column": "period_end_date", "release_date_column": "release_date", "metric_name_column": "metric_name", "metric_value_column": "metric_value"},
    "shares_outstanding": {"effective_date_column": "effective_date", "shares_outstanding_column": "shares_outstanding"},
    "classifications": {"effective_date_column": "effective_date", "sector_column": "sector", "industry_column": "industry"},
    "memberships": {"effective_date_column": "effective_date", "index_column": "index_name", "is_member_column": "is_member"},
    "borrow_availability": {"effective_date_column": "effective_date", "is_borrowable_column": "is_borrowable", "borrow_fee_bps_column": "borrow_fee_bps"},
    "trading_status": {"effective_date_column": "effective_date", "is_tradable_column": "is_tradable", "status_reason_column": "status_reason"},
}
_LISTS = ("fundamental_metrics", "valuation_metrics", "quality_ratio_metrics", "growth_metrics", "stability_ratio_metrics", "classification_fields", "membership_indexes", "borrow_fields")
#: The other sections: key -> default. Ellipsis: must be given.
SECTIONS: dict[str, dict] = {
    "data": {"path": ..., "price_adjustment": "raw"},
    "dataset": {"forward_horizons": [1], "volatility_window": 20, "average_volume_window": 20, **dict.fromkeys(WINDOWS), "benchmark_residual_return_window": None, "benchmark_rolling_window": None, **{k: [] for k in _LISTS}, "include_market_cap": False, "market_cap_bucket_count": None},
    "universe": {"min_price": None, "min_average_volume": None, "min_average_dollar_volume": None, "min_listing_history_days": None, "required_membership_indexes": [], "require_tradable": False, "lag": 1, "average_volume_window": None, "average_dollar_volume_window": None},
    "signal": {"name": ..., "lookback": None, "short_window": None, "long_window": None, "winsorize_quantile": None, "clip_lower_bound": None, "clip_upper_bound": None, "cross_sectional_residualize_columns": [], "cross_sectional_neutralize_group_column": None, "cross_sectional_normalization": "none", "cross_sectional_group_column": None},
    "portfolio": {"construction": "long_only", "top_n": 1, "bottom_n": None, "weighting": "equal", "exposure": 1.0, "long_exposure": 1.0, "short_exposure": 1.0, "max_position_weight": None, "position_cap_column": None, "group_column": None, "max_group_weight": None, "factor_exposure_bounds": []},
    "backtest": {"signal_delay": 1, "fill_timing": "close", "rebalance_frequency": "daily", "transaction_cost_bps": None, "commission_bps": 0.0, "slippage_bps": 0.0, "commission_bps_column": None, "slippage_bps_column": None, "liquidity_bucket_column": None, "slippage_bps_by_liquidity_bucket": [], "market_impact_bps_per_turnover": 0.0, "borrow_fee_bps_column": None, "shortable_column": None, "tradable_column": None, "can_buy_column": None, "can_sell_column": None, "max_trade_weight_column": None, "max_participation_rate": None, "participation_notional": None, "min_trade_weight": None, "max_turnover": None, "initial_nav": 1.0},
    "diagnostics": {"forward_return_column": "forward_return_1d", "ic_method": "pearson", "n_quantiles": 5, "min_observations": 5, "rolling_ic_window": 20, "group_columns": [], "exposure_columns": []},
    **{k: {"path": ..., **v} for k, v in TABLES.items()},
}
SECTIONS["benchmark"] |= {"name": "Benchmark", "rolling_window": 20}
SECTIONS["calendar"] |= {"name": "Trading Calendar"}
_ALWAYS = ("dataset", "diagnostics")


def load_config(path: str | Path) -> dict[str, dict]:
    """Section -> options with defaults; sections that the file lacks are missing, but
    for dataset and diagnostics."""
    path = Path(path)
    try:
        raw = tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    return parse_config(raw, path.parent)


def parse_config(raw: dict, base: Path) -> dict[str, dict]:
    if unknown := set(raw) - set(SECTIONS):
        raise ConfigError(f"unknown sections: {sorted(unknown)}")
    if "data" not in raw:
        raise ConfigError("[data] is missing")
    out = {}
    for name in [s for s in SECTIONS if s in raw or s in _ALWAYS]:
        given, known = raw.get(name, {}), SECTIONS[name]
        if not isinstance(given, dict) or set(given) - set(known):
            raise ConfigError(f"[{name}] has unknown keys: {sorted(set(given) - set(known)) if isinstance(given, dict) else given}")
        if missing := [k for k, v in known.items() if v is ... and k not in given]:
            raise ConfigError(f"[{name}] lacks {missing}")
        out[name] = {**known, **given}
        if "path" in known and "://" not in out[name]["path"]:
            out[name]["path"] = str((base / out[name]["path"]).resolve())
    if out["data"]["price_adjustment"] not in ("raw", "split_adjusted"):
        raise ConfigError("price_adjustment is raw or split_adjusted")
    needs = [("split_adjusted", out["data"]["price_adjustment"] == "split_adjusted", "corporate_actions")]
    d, u = out["dataset"], out.get("universe", SECTIONS["universe"])
    needs += [(k, bool(d[k]), "fundamentals") for k in _LISTS[:5]]
    needs += [("classification_fields", bool(d["classification_fields"]), "classifications"), ("membership_indexes", bool(d["membership_indexes"]), "memberships"), ("borrow_fields", bool(d["borrow_fields"]), "borrow_availability")]
    needs += [("market cap", d["include_market_cap"] or d["market_cap_bucket_count"] is not None, "shares_outstanding"), ("require_tradable", u["require_tradable"], "trading_status")]
    needs += [("required_membership_indexes", bool(u["required_membership_indexes"]), "memberships")]
    needs += [(k, d[k] is not None, "benchmark") for k in ("benchmark_residual_return_window", "benchmark_rolling_window")]
    for what, used, section in needs:
        if used and section not in out:
            raise ConfigError(f"{what} needs [{section}]")
    _check(out)
    return out


def _check(cfg: dict) -> None:
    """Rules between options; the first that is broken is an error."""
    d, g, u = cfg["dataset"], cfg["diagnostics"], cfg.get("universe")
    rules = [
        ("market_cap_bucket_count must be at least 2", d["market_cap_bucket_count"] is not None and d["market_cap_bucket_count"] < 2),
        ("market_cap_bucket_count needs include_market_cap", d["market_cap_bucket_count"] is not None and not d["include_market_cap"]),
        ("higher_moments_window must be at least 4", d["higher_moments_window"] is not None and d["higher_moments_window"] < 4),
        ("ic_method is pearson or spearman", g["ic_method"] not in ("pearson", "spearman")),
        ("n_quantiles must be at least 2", g["n_quantiles"] < 2),
        ("min_observations must not be below n_quantiles", g["min_observations"] < g["n_quantiles"]),
        ("rolling_ic_window must be at least 2", g["rolling_ic_window"] < 2),
    ]
    rules += [(f"[{t}] path must end in .csv or .parquet", not cfg[t]["path"].lower().endswith((".csv", ".parquet"))) for t in ("data", *TABLES) if t in cfg]
    if s := cfg.get("signal"):
        rules.append(("clip bounds come in pairs", (s["clip_lower_bound"] is None) != (s["clip_upper_bound"] is None)))
        rules.append(("short_window must be below long_window", s["name"] == "trend" and (s["short_window"] or 20) >= (s["long_window"] or 60)))
    if u:
        filters = ("min_price", "min_average_volume", "min_average_dollar_volume", "min_listing_history_days")
        rules.append(("[universe] needs a rule", all(u[k] is None for k in filters) and not u["required_membership_indexes"] and not u["require_tradable"]))
        rules += [(f"{k}_window needs min_{k}", u[f"{k}_window"] is not None and u[f"min_{k}"] is None) for k in ("average_volume", "average_dollar_volume")]
    if p := cfg.get("portfolio"):
        least = p["exposure"] if p["construction"] == "long_only" else min(p["long_exposure"], p["short_exposure"])
        rules += [(f"{k} must not exceed the exposure", p[k] is not None and p[k] > least) for k in ("max_position_weight", "max_group_weight")]
    for message, broken in rules:
        if broken:
            raise ConfigError(message)
    if "backtest" in cfg:
        try:
            backtest_settings(cfg)
        except (ValueError, KeyError, TypeError) as e:
            raise ConfigError(f"[backtest]: {e}") from e


def load_table(spark: SparkSession, cfg: dict, section: str) -> DataFrame:
    o = cfg[section]
    return S.load(spark, o["path"], section, {o[k]: v for k, v in TABLES[section].items() if o[k] != v})


def load_bars(spark: SparkSession, cfg: dict) -> DataFrame:
    bars = S.load(spark, cfg["data"]["path"], "ohlcv")
    if "calendar" in cfg:
        S.dates_on_calendar(bars, load_table(spark, cfg, "calendar"))
    return S.split_adjust(bars, load_table(spark, cfg, "corporate_actions")) if cfg["data"]["price_adjustment"] == "split_adjusted" else bars


def build_dataset(spark: SparkSession, cfg: dict) -> DataFrame:
    """The point-in-time panel: only the tables that an option needs are read."""
    d, u, sessions = cfg["dataset"], cfg.get("universe"), None
    df = load_bars(spark, cfg)
    if "calendar" in cfg:
        sessions = load_table(spark, cfg, "calendar")
    if "symbol_metadata" in cfg:
        df = J.attach_symbol_metadata(df, load_table(spark, cfg, "symbol_metadata"))
    df = X.average_volume(X.rolling_volatility(X.returns(df), d["volatility_window"]), d["average_volume_window"])
    for h in d["forward_horizons"]:
        df = X.forward_return(df, h)
    for k, feature in WINDOWS.items():
        if d[k] is not None:
            df = feature(df, d[k])
    pairs = [*d["quality_ratio_metrics"], *d["stability_ratio_metrics"]]
    metrics = list(dict.fromkeys([*d["fundamental_metrics"], *d["valuation_metrics"], *[m for p in pairs for m in p]]))
    if metrics or d["growth_metrics"]:
        f = load_table(spark, cfg, "fundamentals")
        df = J.attach_fundamentals(df, f, metrics, sessions)
        for m in map(J.slug, d["valuation_metrics"]):
            df = X.price_ratio(df, f"fundamental_{m}", f"valuation_{m}_to_price")
        for kind in ("quality", "stability"):
            for a, b in ((J.slug(a), J.slug(b)) for a, b in d[f"{kind}_ratio_metrics"]):
                df = X.guarded_ratio(df, f"{kind}_{a}_to_{b}", f"fundamental_{a}", f"fundamental_{b}")
        if d["growth_metrics"]:
            df = J.attach_growth(df, f, d["growth_metrics"], sessions)
    if d["classification_fields"]:
        df = J.attach_classifications(df, load_table(spark, cfg, "classifications"), d["classification_fields"], sessions)
    indexes = list(dict.fromkeys([*d["membership_indexes"], *(u["required_membership_indexes"] if u else [])]))
    if indexes:
        df = J.attach_memberships(df, load_table(spark, cfg, "memberships"), indexes, sessions)
    if d["borrow_fields"]:
        df = J.attach_borrow(df, load_table(spark, cfg, "borrow_availability"), d["borrow_fields"], sessions)
    if "trading_status" in cfg:
        df = J.attach_trading_status(df, load_table(spark, cfg, "trading_status"), sessions=sessions)
    if d["include_market_cap"] or d["market_cap_bucket_count"] is not None:
        df = J.attach_shares(df, load_table(spark, cfg, "shares_outstanding"), sessions)
        if d["market_cap_bucket_count"] is not None:
            df = J.market_cap_buckets(df, d["market_cap_bucket_count"])
    if "benchmark" in cfg:
        df = X.with_benchmark(df, load_table(spark, cfg, "benchmark"))
        # Without any window the benchmark's statistics have the default one.
        if d["benchmark_rolling_window"] is not None or d["benchmark_residual_return_window"] is None:
            df = X.benchmark_statistics(df, d["benchmark_rolling_window"] or BENCHMARK_WINDOW)
        if d["benchmark_residual_return_window"] is not None:
            df = X.benchmark_residual(df, d["benchmark_residual_return_window"])
    if u:
        window = lambda k: d["average_volume_window"] if u[k] is None else u[k]
        df = apply_universe(df, UniverseRules(u["min_price"], u["min_average_volume"], window("average_volume_window"), u["min_average_dollar_volume"], window("average_dollar_volume_window"), u["min_listing_history_days"], tuple(u["required_membership_indexes"]), u["require_tradable"], u["lag"]), sessions)
    return df


def _need(cfg: dict, section: str) -> dict:
    if section not in cfg:
        raise ConfigError(f"[{section}] is missing")
    return cfg[section]


def factor_parameters(cfg: dict) -> dict[str, int]:
    s = _need(cfg, "signal")
    given = {"lookback": s["lookback"], "short": s["short_window"], "long": s["long_window"]}
    return {k: v for k, v in given.items() if v is not None}


def add_signal(df: DataFrame, cfg: dict) -> tuple[DataFrame, str]:
    """The factor, missing where the universe excludes the row, then the transforms."""
    return refine(*X.factor_signal(df, _need(cfg, "signal")["name"], **factor_parameters(cfg)), cfg)


def refine(df: DataFrame, column: str, cfg: dict) -> tuple[DataFrame, str]:
    s = _need(cfg, "signal")
    if "universe" in cfg:
        df = mask_signal(df, column)
    clip = None if s["clip_lower_bound"] is None else (s["clip_lower_bound"], s["clip_upper_bound"])
    return standard_transform(df, column, s["winsorize_quantile"], clip, s["cross_sectional_residualize_columns"], s["cross_sectional_neutralize_group_column"], s["cross_sectional_normalization"], s["cross_sectional_group_column"])


def add_weights(df: DataFrame, signal: str, cfg: dict) -> DataFrame:
    p = _need(cfg, "portfolio")
    bounds = [P.ExposureBound(b["column"], b.get("min_exposure"), b.get("max_exposure")) for b in p["factor_exposure_bounds"]]
    rest = {"weighting": p["weighting"], "max_weight": p["max_position_weight"], "cap_column": p["position_cap_column"], "group": p["group_column"], "group_cap": p["max_group_weight"], "bounds": bounds}
    if p["construction"] == "long_only":
        return P.long_only(df, signal, p["top_n"], exposure=p["exposure"], **rest)
    if p["construction"] != "long_short" or p["bottom_n"] is None:
        raise ConfigError("construction is long_only, or long_short with bottom_n")
    return P.long_short(df, signal, p["top_n"], p["bottom_n"], long_exposure=p["long_exposure"], short_exposure=p["short_exposure"], **rest)


def backtest_settings(cfg: dict) -> BacktestSettings:
    b = _need(cfg, "backtest")
    same = {k: b[k] for k in ("signal_delay", "commission_bps", "slippage_bps", "commission_bps_column", "slippage_bps_column", "market_impact_bps_per_turnover", "max_trade_weight_column", "max_participation_rate", "participation_notional", "max_turnover", "initial_nav")}
    columns = {k: b[f"{k}_column"] for k in ("shortable", "tradable", "can_buy", "can_sell", "borrow_fee_bps")}
    buckets = tuple((x["bucket"], x["slippage_bps"]) for x in b["slippage_bps_by_liquidity_bucket"])
    return BacktestSettings(transaction_cost_bps=b["transaction_cost_bps"], fill=b["fill_timing"], rebalance=b["rebalance_frequency"], liquidity_bucket=b["liquidity_bucket_column"], slippage_bps_by_bucket=buckets, min_trade_weight=b["min_trade_weight"] or 0.0, **same, **columns)


def backtest(spark: SparkSession, cfg: dict) -> tuple[DataFrame, str, DataFrame]:
    """The panel with signal and weights, the signal's column, and the daily results
    (with the benchmark's, if there is one)."""
    df, signal = add_signal(build_dataset(spark, cfg), cfg)
    df = add_weights(df, signal, cfg)
    daily = run_backtest(df, backtest_settings(cfg))
    if "benchmark" in cfg:
        benchmark = load_table(spark, cfg, "benchmark")
        S.same_dates(daily, benchmark)
        daily = attach_benchmark(daily, benchmark)
    return df, signal, daily


def summaries(panel: DataFrame, signal: str, daily: DataFrame, cfg: dict) -> dict[str, DataFrame]:
    """The report's tables by title, each lazy."""
    g, d = cfg["diagnostics"], cfg["dataset"]
    label = g["forward_return_column"]
    ics = A.ic_series(panel, signal, label, g["ic_method"], g["min_observations"])
    buckets = A.quantile_daily(A.quantile_rows(panel, signal, label, g["n_quantiles"], g["min_observations"]))
    horizons = {h: f"forward_return_{h}d" for h in sorted(d["forward_horizons"])}
    weight = "portfolio_weight"
    out = {"Data Summary": A.market_summary(panel), "Data Quality Summary": A.quality_summary(panel)}
    if "universe" in cfg:
        out |= {"Universe Summary": A.universe_summary(panel), "Universe Exclusions": A.reason_histogram(panel).orderBy("reason")}
    out |= {"Execution Summary": A.execution_summary(daily), "Performance Summary": A.performance(daily), "Risk Summary": A.risk(daily)}
    if "benchmark" in cfg:
        out |= {"Relative Performance": A.relative_performance(daily), "Benchmark Risk": A.rolling_benchmark_risk_summary(A.rolling_benchmark_risk(daily, cfg["benchmark"]["rolling_window"]))}
    out |= {
        "Concentration": A.concentration(panel, weight), "Diversification": A.diversification(panel, weight),
        "IC Summary": A.ic_summary(ics), "Rolling IC": A.rolling_ic_summary(A.rolling_ic(ics, g["rolling_ic_window"])),
        "IC Decay": A.ic_decay(panel, signal, horizons, g["ic_method"], g["min_observations"]), "Quantile Returns": A.quantile_returns(buckets).orderBy("bucket"),
        "Quantile Spread": A.spread_summary(A.quantile_spread(buckets)), "Coverage": A.coverage_summary(A.coverage(panel, signal, label)),
    }
    for c in g["group_columns"]:
        out[f"IC by {c}"] = A.ic_summary(A.ic_series(panel, signal, label, g["ic_method"], g["min_observations"], c), (c,)).orderBy(c)
        out[f"Exposure by {c}"] = A.group_exposure(panel, weight, c).orderBy("group_value")
        out[f"Coverage by {c}"] = A.coverage_summary(A.coverage(panel, signal, label, c), (c,)).orderBy(c)
    if g["exposure_columns"]:
        out["Exposures"] = A.numeric_exposure(panel, weight, g["exposure_columns"])
    return out


def charts(panel: DataFrame, signal: str, daily: DataFrame, cfg: dict) -> dict[str, str]:
    g = cfg["diagnostics"]
    label = g["forward_return_column"]
    ics = A.ic_series(panel, signal, label, g["ic_method"], g["min_observations"])
    buckets = A.quantile_daily(A.quantile_rows(panel, signal, label, g["n_quantiles"], g["min_observations"]))
    running = add(ics, cumulative_ic=F.sum("ic").over(A.ALL().rowsBetween(-(1 << 31), 0)))
    out = {
        "nav": R.chart("Net asset value", daily, "date", ["net_nav", "gross_nav", *(["benchmark_nav"] if "benchmark" in cfg else [])]),
        "drawdown": R.chart("Drawdown", A.drawdowns(daily), "date", ["drawdown"]),
        "exposure_turnover": R.chart("Exposure and turnover", daily, "date", ["gross_exposure", "net_exposure", "turnover"]),
        "ic": R.chart("Information coefficient", ics, "date", ["ic"]),
        "cumulative_ic": R.chart("Cumulative information coefficient", running, "date", ["cumulative_ic"]),
        "coverage": R.chart("Coverage", A.coverage(panel, signal, label), "date", ["signals", "labels", "usable"]),
        "quantile_cumulative": R.chart("Cumulative return by quantile", A.quantile_cumulative(buckets), "date", ["cumulative_return"], by="bucket"),
        "rolling_ic": R.chart("Rolling information coefficient", A.rolling_ic(ics, g["rolling_ic_window"]), "date", ["rolling_mean_ic", "rolling_ic_ir"]),
        "ic_decay": R.chart("Mean information coefficient by horizon", A.ic_summary(A.ic_decay(panel, signal, {h: f"forward_return_{h}d" for h in sorted(cfg["dataset"]["forward_horizons"])}, g["ic_method"], g["min_observations"]), ("horizon",)), "horizon", ["mean_ic", "ic_ir"]),
        "quantile_mean": R.chart("Mean return by quantile", A.quantile_returns(buckets), "bucket", ["average_return"]),
        "quantile_spread": R.chart("Quantile spread", A.quantile_spread(buckets), "date", ["spread"]),
    }
    if "benchmark" in cfg:
        out["benchmark_risk"] = R.chart("Rolling beta and correlation", A.rolling_benchmark_risk(daily, cfg["benchmark"]["rolling_window"]), "date", ["rolling_beta", "rolling_correlation"])
    for c in g["group_columns"]:
        out[f"ic_by_{c}"] = R.chart(f"IC by {c}", A.ic_series(panel, signal, label, g["ic_method"], g["min_observations"], c), "date", ["ic"], by=c)
        out[f"coverage_by_{c}"] = R.chart(f"Usable rows by {c}", A.coverage(panel, signal, label, c), "date", ["usable"], by=c)
    return out


def validation_text(spark: SparkSession, cfg: dict) -> str:
    """Loads every table of the configuration, which checks it, and sums up the bars."""
    bars = load_bars(spark, cfg)
    parts = {"Data Summary": A.market_summary(bars), "Data Quality Summary": A.quality_summary(bars)}
    for section in [t for t in TABLES if t in cfg]:
        parts[section] = A.source_summary(load_table(spark, cfg, section), section)
    return R.report_text("Data Validation", parts)

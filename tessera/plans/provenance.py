"""Where each column of a panel comes from: its role, family, sources and inputs, when its
value is known, when it is missing, and the options that made it. One rule a family of
columns, matched by name, so a new feature needs one line; the identity of a feature
plan is a digest of what the rules say.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from ..operators.features import get_factor
from ..operators.transforms import standard_steps
from ..sinks.cache import fingerprint
from . import workflow as W

CLOSE = "known at the close of the row's date"
NEXT = "a release is used from the session after its date on"
ACTIVE = "a record is used from the first session on or after its effective date on"
WINDOW = "missing until the symbol's window is full"
BASELINE = "missing until the window before the row is full"


@dataclass(frozen=True)
class ColumnSource:
    column: str
    role: str  # key, feature, label, descriptor, filter or signal
    family: str
    source: str
    inputs: tuple[str, ...]
    timing: str
    missing: str
    parameters: dict = field(default_factory=dict)


#: name pattern -> role, family, source, inputs, timing, missing. Groups named n and m are
#: windows or horizons; other named groups may stand in the inputs.
RULES = [(re.compile(p), *rest) for p, *rest in [
    (r"date|symbol", "key", "key", "ohlcv", (), CLOSE, "never"),
    (r"open|high|low|close|volume", "feature", "bar", "ohlcv", (), CLOSE, "never"),
    (r"(price|volume)_adjustment_factor", "descriptor", "adjustment", "corporate_actions", ("split_ratio",), "splits with a later ex-date, known in hindsight only", "never"),
    (r"daily_return|log_return", "feature", "return", "ohlcv", ("close",), CLOSE, "missing on a symbol's first row"),
    (r"rolling_volatility_(?P<n>\d+)d", "feature", "rolling_return", "ohlcv", ("daily_return",), CLOSE, WINDOW),
    (r"rolling_average_volume_(?P<n>\d+)d", "feature", "rolling_liquidity", "ohlcv", ("volume",), CLOSE, WINDOW),
    (r"forward_return_(?P<n>\d+)d", "label", "forward_return", "ohlcv", ("close",), "looks ahead; never an input of its own row", "missing on a symbol's last rows"),
    (r"(normalized_)?average_true_range_(?P<n>\d+)d", "feature", "range", "ohlcv", ("high", "low", "close"), CLOSE, WINDOW),
    (r"amihud_illiquidity_(?P<n>\d+)d", "feature", "liquidity", "ohlcv", ("daily_return", "close", "volume"), CLOSE, "missing until the window is full of positive dollar volumes"),
    (r"dollar_volume_(shock|zscore)_(?P<n>\d+)d", "feature", "liquidity", "ohlcv", ("close", "volume"), "the day against the rows before it", BASELINE),
    (r"relative_dollar_volume_(?P<n>\d+)d", "feature", "liquidity", "ohlcv", ("close", "volume"), "the day against the rows before it", BASELINE),
    (r"(volume_shock|relative_volume)_(?P<n>\d+)d", "feature", "liquidity", "ohlcv", ("volume",), "the day against the rows before it", BASELINE),
    (r"(garman_klass|rogers_satchell)_volatility_(?P<n>\d+)d", "feature", "range_volatility", "ohlcv", ("open", "high", "low", "close"), CLOSE, WINDOW),
    (r"parkinson_volatility_(?P<n>\d+)d", "feature", "range_volatility", "ohlcv", ("high", "low"), CLOSE, WINDOW),
    (r"yang_zhang_volatility_(?P<n>\d+)d", "feature", "range_volatility", "ohlcv", ("open", "high", "low", "close"), CLOSE, WINDOW),
    (r"realized_(downside_|upside_)?volatility_(?P<n>\d+)d", "feature", "realized_volatility", "ohlcv", ("daily_return",), CLOSE, WINDOW),
    (r"rolling_(skewness|kurtosis)_(?P<n>\d+)d", "feature", "higher_moment", "ohlcv", ("daily_return",), CLOSE, WINDOW),
    (r"benchmark_return", "feature", "benchmark", "benchmark", (), CLOSE, "never: dates must match"),
    (r"rolling_benchmark_(beta|correlation)_(?P<n>\d+)d", "feature", "benchmark_statistic", "ohlcv+benchmark", ("daily_return", "benchmark_return"), CLOSE, WINDOW),
    (r"benchmark_residual_return_(?P<n>\d+)d", "feature", "benchmark_statistic", "ohlcv+benchmark", ("daily_return", "benchmark_return"), "fitted on the rows before the row", BASELINE),
    (r"fundamental_(?P<a>.+)", "feature", "fundamental", "fundamentals", ("{a}",), NEXT, "missing before the first release, or where the newest is missing"),
    (r"valuation_(?P<a>.+)_to_price", "feature", "valuation", "fundamentals+ohlcv", ("fundamental_{a}", "close"), NEXT, "missing with its numerator"),
    (r"(?P<k>quality|stability)_(?P<a>.+)_to_(?P<b>.+)", "feature", "ratio", "fundamentals", ("fundamental_{a}", "fundamental_{b}"), NEXT, "missing with an input, or where the denominator is not positive"),
    (r"growth_(?P<a>.+)", "feature", "growth", "fundamentals", ("{a}", "{a} of the period before"), NEXT, "missing without a prior period that was positive and released by then"),
    (r"classification_(?P<a>.+)", "descriptor", "classification", "classifications", ("{a}",), ACTIVE, "missing before the first record"),
    (r"membership_(?P<a>.+)", "descriptor", "membership", "memberships", ("is_member",), ACTIVE, "missing before the first record"),
    (r"borrow_fee_bps", "descriptor", "borrow", "borrow_availability", ("borrow_fee_bps",), ACTIVE, "missing before the first record, or where it has no fee"),
    (r"borrow_is_borrowable", "descriptor", "borrow", "borrow_availability", ("is_borrowable",), ACTIVE, "missing before the first record"),
    (r"trading_(?P<a>.+)", "descriptor", "trading_status", "trading_status", ("{a}",), ACTIVE, "missing before the first record"),
    (r"(listing|delisting)_date", "descriptor", "listing", "symbol_metadata", (), "the day's own listing state", "no delisting date while listed"),
    (r"shares_outstanding", "descriptor", "shares", "shares_outstanding", (), ACTIVE, "missing before the first record"),
    (r"market_cap", "feature", "size", "shares_outstanding+ohlcv", ("shares_outstanding", "close"), ACTIVE, "missing with shares_outstanding"),
    (r"market_cap_bucket", "descriptor", "size_bucket", "shares_outstanding+ohlcv", ("market_cap",), "same-date ranks of market_cap", "missing where a date has too few different values"),
    (r"is_universe_eligible|universe_.+|passes_.+", "filter", "universe", "ohlcv and what the rules name", (), "rows before the row only", "a value that is missing passes nothing"),
    (r"(momentum|mean_reversion)_signal_(?P<n>\d+)d(?P<t>_.+)?", "signal", "factor", "ohlcv", ("close",), CLOSE, WINDOW),
    (r"trend_signal_(?P<n>\d+)_(?P<m>\d+)d(?P<t>_.+)?", "signal", "factor", "ohlcv", ("close",), CLOSE, WINDOW),
]]


def column_source(column: str) -> ColumnSource:
    """What the rules say of a column; one that no rule knows is an extra input column."""
    for pattern, role, family, source, inputs, timing, missing in RULES:
        if m := pattern.fullmatch(column):
            groups = {k: v for k, v in m.groupdict().items() if v is not None}
            numbers = {k: int(groups[k]) for k in ("n", "m") if k in groups}
            return ColumnSource(column, role, family, source, tuple(i.format(**groups) for i in inputs), timing, missing, numbers)
    return ColumnSource(column, "feature", "input", "ohlcv", (column,), "as the input says", "as the input says")


def feature_sources(columns: list[str]) -> list[dict]:
    return [asdict(column_source(c)) | {"inputs": list(column_source(c).inputs)} for c in columns]


def signal_source(cfg: dict) -> dict:
    """The factor with its parameters, and each transform with what it reads and makes."""
    s = cfg["signal"]
    factor = get_factor(s["name"])
    parameters = factor["parameters"] | W.factor_parameters(cfg)
    raw = column = factor["column"].format(**parameters)
    clip = None if s["clip_lower_bound"] is None else (s["clip_lower_bound"], s["clip_upper_bound"])
    steps = []
    for name, options, suffix in standard_steps(s["winsorize_quantile"], clip, s["cross_sectional_residualize_columns"], s["cross_sectional_neutralize_group_column"], s["cross_sectional_normalization"], s["cross_sectional_group_column"]):
        steps.append({"transform": name, "options": options, "input": column, "output": f"{column}_{suffix}", "scope": "date and group" if options.get("group") else "date"})
        column = steps[-1]["output"]
    return {"factor": factor["name"], "parameters": parameters, "raw_column": raw, "steps": steps, "column": column, "timing": f"{CLOSE}; transforms see one date; orders come later"}


def plan_identity(columns: list[str], cfg: dict | None = None) -> dict:
    """Digests of the feature plan, the labels and the signal, and one of all: the key of a
    feature cache. Labels look ahead and are no reusable features."""
    sources = feature_sources(columns)
    parts = {
        "features": [x for x in sources if x["role"] not in ("label", "signal")], "labels": [x for x in sources if x["role"] == "label"],
        "signal": signal_source(cfg) if cfg and "signal" in cfg else None,
    }
    named = {k: [x["column"] for x in parts[k]] for k in ("features", "labels")}
    return {"schema_version": 1, **named, "signals": [x["column"] for x in sources if x["role"] == "signal"], "fingerprints": {k: fingerprint(v) for k, v in parts.items()}, "cache_key": fingerprint(parts)}

"""Loading and strict validation of the engine's input tables.

A table is described once (``SPECS``): its columns, their types, its key and its
rules. Validation is one aggregated audit: every rule is a counted predicate and
duplicate keys are counted in the same job, so a source costs one pass (two for the
key). Malformed input raises :class:`DataValidationError`; optional values stay NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class DataValidationError(ValueError):
    """An input table breaks a rule of its kind."""


@dataclass(frozen=True)
class TableSpec:
    columns: dict[str, str]  # name -> date, text, number, flag; '?' at the end: optional
    key: tuple[str, ...]
    rules: dict[str, Callable[[], Column]] = field(default_factory=dict)  # message -> bad rows
    needs_rows: bool = False


def _c(x: str) -> Column:
    return F.col(x)


def _bad(x: str) -> Column:
    return F.isnan(_c(x)) | (F.abs(_c(x)) == float("inf"))


_EFFECTIVE = {"symbol": "text", "effective_date": "date"}
SPECS: dict[str, TableSpec] = {
    "ohlcv": TableSpec(
        {"date": "date", "symbol": "text", "open": "number", "high": "number", "low": "number", "close": "number", "volume": "number"},
        ("symbol", "date"),
        {
            "prices must be positive": lambda: F.least("open", "high", "low", "close") <= 0,
            "volume must not be negative": lambda: _c("volume") < 0,
            "high must not be below low": lambda: _c("high") < _c("low"),
            "open must be within low and high": lambda: ~_c("open").between(_c("low"), _c("high")),
            "close must be within low and high": lambda: ~_c("close").between(_c("low"), _c("high")),
        },
    ),
    "benchmark": TableSpec({"date": "date", "benchmark_return": "number"}, ("date",), {"benchmark_return must be finite and above -1": lambda: _bad("benchmark_return") | (_c("benchmark_return") <= -1)}),
    "calendar": TableSpec({"date": "date"}, ("date",), needs_rows=True),
    "symbol_metadata": TableSpec({"symbol": "text", "listing_date": "date", "delisting_date": "date?"}, ("symbol",), {"delisting_date must not precede listing_date": lambda: _c("delisting_date") < _c("listing_date")}),
    "corporate_actions": TableSpec(
        {"symbol": "text", "ex_date": "date", "action_type": "lower", "split_ratio": "number?", "cash_amount": "number?"},
        ("symbol", "ex_date", "action_type"),
        {
            "action_type must be split or cash_dividend": lambda: ~_c("action_type").isin("split", "cash_dividend"),
            "a split needs a positive split_ratio": lambda: (_c("action_type") == "split") & ~F.coalesce((_c("split_ratio") > 0) & ~_bad("split_ratio"), F.lit(False)),
            "a split has no cash_amount": lambda: (_c("action_type") == "split") & _c("cash_amount").isNotNull(),
            "a dividend needs a positive cash_amount": lambda: (_c("action_type") == "cash_dividend") & ~F.coalesce((_c("cash_amount") > 0) & ~_bad("cash_amount"), F.lit(False)),
            "a dividend has no split_ratio": lambda: (_c("action_type") == "cash_dividend") & _c("split_ratio").isNotNull(),
        },
    ),
    "fundamentals": TableSpec(
        {"symbol": "text", "period_end_date": "date", "release_date": "date", "metric_name": "text", "metric_value": "number"},
        ("symbol", "period_end_date", "release_date", "metric_name"),
        {"metric_value must be finite": lambda: _bad("metric_value"), "release_date must not precede period_end_date": lambda: _c("release_date") < _c("period_end_date")},
    ),
    "shares_outstanding": TableSpec({**_EFFECTIVE, "shares_outstanding": "number"}, ("symbol", "effective_date"), {"shares_outstanding must be finite and positive": lambda: _bad("shares_outstanding") | (_c("shares_outstanding") <= 0)}),
    "classifications": TableSpec({**_EFFECTIVE, "sector": "text", "industry": "text"}, ("symbol", "effective_date")),
    "memberships": TableSpec({**_EFFECTIVE, "index_name": "text", "is_member": "flag"}, ("symbol", "effective_date", "index_name")),
    "borrow_availability": TableSpec({**_EFFECTIVE, "is_borrowable": "flag", "borrow_fee_bps": "number?"}, ("symbol", "effective_date"), {"borrow_fee_bps must be finite and not negative": lambda: _bad("borrow_fee_bps") | (_c("borrow_fee_bps") < 0)}),
    "trading_status": TableSpec({**_EFFECTIVE, "is_tradable": "flag", "status_reason": "text?"}, ("symbol", "effective_date")),
}


def strict_flag(x: Column) -> Column:
    """true/false/1/0 in any case, bool or number; NULL for anything else."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "1.0"), True).when(t.isin("false", "0", "0.0"), False)


def _typed(name: str, kind: str, dtype: str) -> Column:
    x = F.col(f"`{name}`")
    kind = kind.rstrip("?")
    if kind == "number":
        v = F.expr(f"try_cast(`{name}` AS double)")
        return F.when(~F.isnan(v), v)
    if kind == "flag":
        return strict_flag(x)
    if kind == "date":
        if dtype == "date":
            return x
        t = F.expr(f"try_cast(nullif(trim(cast(`{name}` AS string)), '') AS timestamp)")
        return F.when(t == F.date_trunc("day", t), t.cast("date"))  # an intraday time is an error, not truncated
    t = F.nullif(F.trim(x.cast("string")), F.lit(""))
    return F.lower(t) if kind == "lower" else t


def validate(df: DataFrame, kind: str, source: str = "input", rename: dict[str, str] | None = None, trusted: bool = False) -> DataFrame:
    """df in canonical columns, types and order (extras behind), or an error.

    rename: input name -> canonical name. trusted: skip the audit, keep the typing."""
    spec = SPECS[kind]
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    for c, k in spec.columns.items():
        if c not in df.columns:
            if not k.endswith("?"):
                raise DataValidationError(f"{source}: missing column {c}")
            df = df.withColumn(c, F.lit(None).cast("string"))
    dtypes = dict(df.dtypes)
    extras = [F.col(f"`{c}`") for c in df.columns if c not in spec.columns]
    typed = {c: _typed(c, k, dtypes[c]) for c, k in spec.columns.items()}
    out = df.select(*[x.alias(c) for c, x in typed.items()], *extras)
    if trusted:
        return out
    raw = df.select(*[x.alias(c) for c, x in typed.items()], *[F.col(f"`{c}`").alias(f"__raw_{c}") for c in spec.columns])
    checks = {}
    for c, k in spec.columns.items():
        blank = F.trim(F.coalesce(F.col(f"__raw_{c}").cast("string"), F.lit(""))).isin("", "NaN", "nan") if k.endswith("?") else F.lit(False)
        checks[f"{c} has missing or invalid values"] = F.col(c).isNull() & ~blank
    checks |= {m: rule() for m, rule in spec.rules.items()}
    counted = raw.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(x, F.lit(False))).alias(f"c{i}") for i, x in enumerate(checks.values())]).first()
    for i, message in enumerate(checks):
        if counted[f"c{i}"]:
            raise DataValidationError(f"{source}: {message} ({counted[f'c{i}']} rows)")
    if spec.needs_rows and not counted["rows"]:
        raise DataValidationError(f"{source}: no rows")
    twice = out.groupBy(*spec.key).count().where("count > 1").limit(1).collect()
    if twice:
        raise DataValidationError(f"{source}: duplicate key {tuple(twice[0])[:-1]}")
    return out


def load(spark: SparkSession, path: str, kind: str, rename: dict[str, str] | None = None, trusted: bool = False) -> DataFrame:
    """A CSV or Parquet table, by suffix, validated."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True, inferSchema=False)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"only .csv and .parquet are read: {path}")
    return validate(df, kind, path, rename, trusted)


def dates_on_calendar(dates: DataFrame, calendar: DataFrame) -> None:
    """An error that names up to ten dates outside the calendar."""
    out = [r[0] for r in dates.select("date").distinct().join(calendar, "date", "left_anti").orderBy("date").limit(10).collect()]
    if out:
        raise DataValidationError(f"dates outside the trading calendar: {', '.join(map(str, out))}")


def same_dates(a: DataFrame, b: DataFrame) -> None:
    """An error unless both have the same set of dates."""
    x, y = a.select("date").distinct(), b.select("date").distinct()
    if x.join(y, "date", "left_anti").limit(1).collect() or y.join(x, "date", "left_anti").limit(1).collect():
        raise DataValidationError("dates do not match exactly")


def split_adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Backward split adjustment: rows strictly before an ex_date have prices divided
    and volume multiplied by the product of the ratios to come; dividends change nothing.

    The future product is a window over each symbol's splits; each split becomes the
    interval of dates that it is the next one for, and bars meet one interval."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ex_date")
    splits = actions.where("action_type = 'split'").groupBy("symbol", "ex_date").agg(F.product("split_ratio").alias("ratio"))
    back = Window.partitionBy("symbol").orderBy(F.col("ex_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = splits.select("symbol", F.coalesce(F.lag("ex_date").over(w), F.lit("0001-01-01").cast("date")).alias("__from"), F.col("ex_date").alias("__to"), F.product("ratio").over(back).alias("__f"))
    j = bars.join(steps.withColumnRenamed("symbol", "__s"), (F.col("symbol") == F.col("__s")) & (F.col("date") >= F.col("__from")) & (F.col("date") < F.col("__to")), "left")
    f = F.coalesce("__f", F.lit(1.0))
    prices = {c: F.col(c) / f for c in ("open", "high", "low", "close")}
    return j.withColumns({**prices, "volume": F.col("volume") * f, "price_adjustment_factor": 1 / f, "volume_adjustment_factor": f}).drop("__s", "__from", "__to", "__f")

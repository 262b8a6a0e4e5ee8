"""Performance, risk and factor diagnostics.

Per-date results are aggregations with map-side combine; everything after them works
on one row a date, so windows over all dates are small whatever the panel's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.panel import day
from .asof import rank_bucket
from .transforms import average_rank

ALL = lambda: Window.partitionBy().orderBy("date")
TOLERANCE = 1e-12


def _growth(x: str) -> Column:
    return F.product(1 + F.col(x)) - 1


def drawdowns(daily: DataFrame, returns: str = "net_return") -> DataFrame:
    """NAV, its running maximum (from the first NAV on) and the drawdown."""
    w = ALL().rowsBetween(Window.unboundedPreceding, 0)
    d = daily.select("date", F.product(1 + F.col(returns)).over(w).alias("nav")).withColumn("running_max", F.max("nav").over(w))
    return d.withColumn("drawdown", F.col("nav") / F.col("running_max") - 1)


def performance(daily: DataFrame, periods: int = 252, returns: str = "net_return", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each of the keys' values), drawdown included, in one pass."""
    x = F.col(returns)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("__nav", F.product(1 + x).over(w)).withColumn("__low", F.col("__nav") / F.max("__nav").over(w) - 1)
    sd = F.stddev_samp(x)
    return d.groupBy(*keys).agg(
        F.count("*").alias("periods"), _growth(returns).alias("cumulative_return"),
        (F.pow(F.product(1 + x), periods / F.count("*")) - 1).alias("annualized_return"), (sd * periods**0.5).alias("annualized_volatility"),
        F.when(sd > 0, F.avg(x) / sd * periods**0.5).alias("sharpe_ratio"), F.min("__low").alias("max_drawdown"),
        F.avg("turnover").alias("average_turnover"), F.sum("turnover").alias("total_turnover"), F.avg((x > 0).cast("double")).alias("hit_rate"),
    )


def relative_performance(attached: DataFrame, periods: int = 252) -> DataFrame:
    x, b = F.col("net_return"), F.col("benchmark_return")
    sd, up, base = F.stddev_samp(x - b), F.product(1 + x), F.product(1 + b)
    return attached.agg(
        F.count("*").alias("periods"), (base - 1).alias("benchmark_cumulative_return"), (F.pow(base, periods / F.count("*")) - 1).alias("benchmark_annualized_return"),
        (up / base - 1).alias("excess_cumulative_return"), (F.pow(up / base, periods / F.count("*")) - 1).alias("annualized_excess_return"),
        F.avg(x - b).alias("average_daily_excess_return"), (sd * periods**0.5).alias("tracking_error"), F.when(sd > 0, F.avg(x - b) / sd * periods**0.5).alias("information_ratio"),
        F.avg((x > b).cast("double")).alias("excess_hit_rate"),
    )


def risk(daily: DataFrame, confidence: float = 0.95, periods: int = 252, returns: str = "net_return") -> DataFrame:
    if not 0 < confidence < 1:
        raise ValueError("the confidence is between 0 and 1")
    d = daily.select(F.col(returns).alias("x"), "gross_exposure", "net_exposure").withColumn("q", F.percentile("x", F.lit(1 - confidence)).over(Window.partitionBy()))
    return d.agg(
        F.count("*").alias("periods"), (F.stddev_samp("x") * periods**0.5).alias("realized_volatility"), (F.sqrt(F.avg(F.pow(F.least("x", F.lit(0.0)), 2.0))) * periods**0.5).alias("downside_volatility"),
        F.first("q").alias("value_at_risk"), F.avg(F.when(F.col("x") <= F.col("q"), F.col("x"))).alias("conditional_value_at_risk"), F.lit(float(confidence)).alias("var_confidence"),
        F.avg("gross_exposure").alias("average_gross_exposure"), F.avg("net_exposure").alias("average_net_exposure"),
    )


def rolling_benchmark_risk(attached: DataFrame, n: int = 20, returns: str = "net_return") -> DataFrame:
    w = ALL().rowsBetween(-(n - 1), 0)
    x, b = F.col(returns), F.col("benchmark_return")
    cov, vx, vb, ok = F.covar_samp(x, b).over(w), F.var_samp(x).over(w), F.var_samp(b).over(w), F.count(x).over(w) == n
    return attached.select("date", F.when(ok & (vb > 0), cov / vb).alias("rolling_beta"), F.when(ok & (vb > 0) & (vx > 0), cov / F.sqrt(vb) / F.sqrt(vx)).alias("rolling_correlation"))


def rolling_benchmark_risk_summary(rolling: DataFrame) -> DataFrame:
    both = F.col("rolling_beta").isNotNull() & F.col("rolling_correlation").isNotNull()
    return rolling.agg(
        F.avg("rolling_beta").alias("average_beta"), F.avg("rolling_correlation").alias("average_correlation"),
        F.max_by("rolling_beta", F.when(both, F.col("date"))).alias("latest_beta"), F.max_by("rolling_correlation", F.when(both, F.col("date"))).alias("latest_correlation"),
    )


def weight_profile(panel: DataFrame, weight: str) -> DataFrame:
    """Per date: gross, net, counts, HHI, largest and five largest shares of gross. The
    five largest are ranked within the date, so no list of a date is made."""
    w = F.col(weight)
    d = panel.select("date", w.alias("w"), F.abs(w).alias("a"), "symbol").withColumn("k", F.row_number().over(day().orderBy(F.col("a").desc(), "symbol")))
    held = F.when(F.col("a") > TOLERANCE, F.col("a")).otherwise(0.0)
    g = d.groupBy("date").agg(
        F.sum("a").alias("gross"), F.sum("w").alias("net"), F.sum(held * held).alias("sq"), F.max("a").alias("largest"), F.sum(F.when(F.col("k") <= 5, held).otherwise(0.0)).alias("five"),
        F.count_if(F.col("a") > TOLERANCE).alias("holdings"), F.count_if(F.col("w") > TOLERANCE).alias("longs"), F.count_if(F.col("w") < -TOLERANCE).alias("shorts"),
    )
    share = lambda x: F.when((F.col("holdings") > 0) & (F.col("gross") > TOLERANCE), x).otherwise(0.0)
    gross = F.col("gross")
    g = g.withColumns({"hhi": share(F.col("sq") / gross / gross), "top1": share(F.col("largest") / gross), "top5": share(F.col("five") / gross)})
    g = g.withColumn("effective", F.when(F.col("hhi") > 0, 1 / F.col("hhi")).otherwise(0.0))
    return g.withColumn("effective_share", F.when(F.col("holdings") > 0, F.col("effective") / F.col("holdings")).otherwise(0.0)).drop("sq", "five")


def concentration(panel: DataFrame, weight: str) -> DataFrame:
    return weight_profile(panel, weight).agg(
        F.count("*").alias("periods"), F.avg("gross").alias("average_gross_exposure"), F.max("gross").alias("max_gross_exposure"), F.avg("net").alias("average_net_exposure"),
        F.avg("hhi").alias("average_herfindahl_index"), F.avg("largest").alias("average_max_abs_weight"),
    )


def diversification(panel: DataFrame, weight: str) -> DataFrame:
    return weight_profile(panel, weight).agg(
        F.count("*").alias("periods"), F.avg("holdings").alias("average_holdings_count"), F.min("holdings").alias("min_holdings_count"), F.avg("longs").alias("average_long_count"), F.avg("shorts").alias("average_short_count"),
        F.avg("effective").alias("average_effective_number_of_positions"), F.min("effective").alias("min_effective_number_of_positions"),
        F.avg("effective_share").alias("average_effective_position_ratio"), F.min("effective_share").alias("min_effective_position_ratio"),
        F.avg("top1").alias("average_top_position_weight_share"), F.max("top1").alias("max_top_position_weight_share"), F.avg("top5").alias("average_top_five_weight_share"), F.max("top5").alias("max_top_five_weight_share"),
    )


def group_exposure(panel: DataFrame, weight: str, group: str) -> DataFrame:
    """Gross, net and number of holdings of groups over the dates on which they occur."""
    g = F.coalesce(F.nullif(F.trim(F.col(group).cast("string")), F.lit("")), F.lit("<missing>"))
    d = panel.groupBy("date", g.alias("group_value")).agg(F.sum(F.abs(weight)).alias("gross"), F.sum(weight).alias("net"), F.count_if(F.abs(weight) > TOLERANCE).alias("held"))
    d = d.groupBy("group_value").agg(
        F.count("*").alias("periods"), F.avg("gross").alias("average_gross_exposure"), F.max("gross").alias("max_gross_exposure"), F.avg("net").alias("average_net_exposure"),
        F.max(F.abs("net")).alias("max_abs_net_exposure"), F.avg("held").alias("average_holdings_count"), F.max("held").alias("max_holdings_count"),
    )
    return d.select(F.lit(group).alias("group_column"), "group_value", (F.col("group_value") == "<missing>").alias("is_missing_group"), *d.columns[1:])


def numeric_exposure(panel: DataFrame, weight: str, columns: list[str]) -> DataFrame:
    """Per column: exposure of held weight, by absolute weight and net, and what of it is
    missing, averaged over all dates of the panel, those without holdings included."""
    w, a = F.col("w"), F.abs("w")
    long = panel.select("date", F.col(weight).alias("w"), F.explode(F.array(*[F.struct(F.lit(c).alias("exposure_column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("date", "w", "e.*")
    held, has = a > TOLERANCE, F.col("x").isNotNull() & ~F.isnan("x")
    some = lambda c, v: F.sum(F.when(c, v).otherwise(0.0))
    d = long.groupBy("exposure_column", "date").agg(
        some(held & has, a * F.col("x")).alias("ax"), some(held & has, w * F.col("x")).alias("nx"), some(held & has, a).alias("with"), some(held & ~has, a).alias("without"),
        F.count_if(held).alias("n"), F.count_if(held & has).alias("n_with"), F.count_if(held & ~has).alias("n_without"),
    )
    usable = F.col("with") > TOLERANCE
    d = d.withColumns({"mean": F.when(usable, F.col("ax") / F.col("with")), "net": F.when(usable, F.col("nx"))})
    latest = lambda c: F.max_by(c, F.when(F.col("mean").isNotNull(), F.col("date")))
    return d.groupBy("exposure_column").agg(
        F.count("*").alias("periods"), F.avg("mean").alias("average_absolute_weighted_exposure"), latest("mean").alias("latest_absolute_weighted_exposure"),
        F.avg("net").alias("average_net_weighted_exposure"), latest("net").alias("latest_net_weighted_exposure"),
        F.avg("with").alias("average_gross_weight_with_exposure"), F.avg("without").alias("average_gross_weight_missing_exposure"),
        F.avg("n").alias("average_active_positions"), F.avg("n_with").alias("average_positions_with_exposure"), F.avg("n_without").alias("average_missing_exposure_positions"),
    )


def execution_summary(daily: DataFrame) -> DataFrame:
    """Dates on which each limit applied, average turnover, exposure and holdings, total costs."""
    limits = ["turnover", "short_availability", "tradability", "buy", "sell", "participation", "trade"]
    dates = {f"{k}_limit_dates": f"{k}_limit_applied" for k in limits} | {"trade_clip_dates": "trade_clip_applied"}
    means = {
        "average_target_turnover": "target_turnover", "average_realized_turnover": "turnover", "average_gross_target_exposure": "gross_target_exposure", "average_gross_exposure": "gross_exposure",
        "average_target_holdings": "target_holdings_count", "average_realized_holdings": "holdings_count", "average_target_effective_weight_gap": "target_effective_weight_gap",
    }
    return daily.agg(
        F.count("*").alias("periods"), F.count_if("is_rebalance_date").alias("rebalance_dates"), *[F.count_if(c).alias(k) for k, c in dates.items()],
        *[F.avg(c).alias(k) for k, c in means.items()],
        *[F.sum(f"{c}_cost").alias(f"total_{c}_cost") for c in ("commission", "slippage", "market_impact", "borrow", "transaction")],
    )


def source_summary(df: DataFrame, kind: str) -> DataFrame:
    """Coverage of an input table of that kind (of ``sources.tables.SPECS``), one row."""
    rows, symbols = F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols")
    span = lambda c, p="": [F.min(c).alias(f"{p}start_date"), F.max(c).alias(f"{p}end_date")]
    flags = lambda c, yes, no: [F.count_if(F.col(c)).alias(yes), F.count_if(~F.col(c)).alias(no)]
    effective = [rows, symbols, *span("effective_date")]
    if kind == "shares_outstanding":
        last = df.groupBy("symbol").agg(F.count("*").alias("n"), F.min("effective_date").alias("a"), F.max("effective_date").alias("b"), F.max_by("shares_outstanding", "effective_date").alias("x"))
        return last.agg(F.sum("n").alias("rows"), F.count("*").alias("symbols"), F.min("a").alias("start_date"), F.max("b").alias("end_date"), F.sum("x").alias("latest_shares_total"))
    return df.agg(*{
        "benchmark": lambda: [rows, *span("date"), F.avg("benchmark_return").alias("average_daily_return"), (F.stddev_samp("benchmark_return") * 252**0.5).alias("realized_volatility")],
        "calendar": lambda: [F.count("*").alias("sessions"), *span("date")],
        "symbol_metadata": lambda: [symbols, *span("listing_date", "listing_"), F.count_if(F.col("delisting_date").isNull()).alias("active_symbols"), F.count("delisting_date").alias("delisted_symbols")],
        "corporate_actions": lambda: [rows, symbols, *span("ex_date"), F.count_if(F.col("action_type") == "split").alias("split_actions"), F.count_if(F.col("action_type") == "cash_dividend").alias("cash_dividend_actions")],
        "fundamentals": lambda: [rows, symbols, F.count_distinct("metric_name").alias("metrics"), F.min("period_end_date").alias("period_start_date"), F.max("period_end_date").alias("period_end_date"), *span("release_date", "release_")],
        "classifications": lambda: [*effective, F.count_distinct("sector").alias("sectors"), F.count_distinct("industry").alias("industries")],
        "memberships": lambda: [*effective, F.count_distinct("index_name").alias("indexes"), *flags("is_member", "member_rows", "non_member_rows")],
        "borrow_availability": lambda: [*effective, *flags("is_borrowable", "borrowable_rows", "not_borrowable_rows"), F.count("borrow_fee_bps").alias("fee_observations")],
        "trading_status": lambda: [*effective, *flags("is_tradable", "tradable_rows", "not_tradable_rows"), F.count("status_reason").alias("reason_observations")],
    }[kind]())


def correlation(y: Column, x: Column) -> Column:
    """Aggregate correlation that is missing, not an error, where one side is constant."""
    vy, vx = F.var_samp(y), F.var_samp(x)
    return F.when((vy > 0) & (vx > 0), F.covar_samp(y, x) / F.sqrt(vy) / F.sqrt(vx))


def _complete(panel: DataFrame, signal: str, label: str, keys: list[str]) -> DataFrame:
    both = F.col(signal).isNotNull() & F.col(label).isNotNull()
    return panel.select(*keys, F.when(both, F.col(signal)).alias("s"), F.when(both, F.col(label)).alias("f"))


def ic_series(panel: DataFrame, signal: str, label: str, method: str = "pearson", least: int = 2, group: str | None = None) -> DataFrame:
    """Per date (and group): correlation of signal and forward return over complete
    rows; with fewer than `least` it is missing but the row stays."""
    keys = ["date", *([group] if group else [])]
    d = _complete(panel.where(F.col(group).isNotNull()) if group else panel, signal, label, keys)
    if method == "spearman":
        d = d.withColumns({c: F.when(F.col(c).isNotNull(), average_rank(F.col(c), keys)) for c in ("s", "f")})
    elif method != "pearson":
        raise ValueError("method is pearson or spearman")
    return d.groupBy(*keys).agg(F.count("s").alias("observations"), F.when(F.count("s") >= least, correlation(F.col("s"), F.col("f"))).alias("ic"))


def ic_summary(ics: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    sd = F.stddev_samp("ic")
    return ics.groupBy(*keys).agg(F.count("*").alias("periods"), F.count("ic").alias("valid_periods"), F.avg("ic").alias("mean_ic"), sd.alias("ic_std"), F.when(sd > 0, F.avg("ic") / sd).alias("ic_ir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"))


def rolling_ic(ics: DataFrame, n: int = 20, least: int | None = None) -> DataFrame:
    w = ALL().rowsBetween(-(n - 1), 0)
    ok = F.count("ic").over(w) >= (least or n)
    sd = F.stddev_samp("ic").over(w)
    return ics.select("date", "ic", F.when(ok, F.avg("ic").over(w)).alias("rolling_mean_ic"), F.when(ok & (sd > 0), F.avg("ic").over(w) / sd).alias("rolling_ic_ir"))


def rolling_ic_summary(rolling: DataFrame) -> DataFrame:
    m = F.col("rolling_mean_ic")
    return rolling.agg(F.max_by(m, F.when(m.isNotNull(), F.col("date"))).alias("latest_rolling_mean_ic"), F.min(m).alias("min_rolling_mean_ic"), F.max(m).alias("max_rolling_mean_ic"), F.count(m).alias("valid_windows"))


def ic_decay(panel: DataFrame, signal: str, horizons: dict[int, str], method: str = "pearson", least: int = 2) -> DataFrame:
    """IC by horizon in long form: labels are unpivoted once and one aggregation follows."""
    long = panel.select("date", "symbol", F.col(signal).alias("__sig"), F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("__lab")) for h, c in horizons.items()])).alias("e")).select("date", "__sig", "e.*")
    return ic_series(long, "__sig", "__lab", method, least, group="horizon")


def quantile_rows(panel: DataFrame, signal: str, label: str, q: int = 5, least: int | None = None) -> DataFrame:
    """Complete rows with their bucket 1..q of the date's ranks (ties by symbol)."""
    least = max(q, least or q)
    d = panel.where(F.col(signal).isNotNull() & F.col(label).isNotNull()).select("date", "symbol", F.col(signal).alias("s"), F.col(label).alias("f"))
    d = d.withColumns({"n": F.count("*").over(day()), "r": F.row_number().over(day().orderBy("s", "symbol"))}).where(F.col("n") >= least)
    return d.select("date", "symbol", "f", rank_bucket(F.col("r"), F.col("n"), q).alias("bucket"))


def quantile_daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy("date", "bucket").agg(F.avg("f").alias("mean_return"))


def quantile_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy("bucket").agg(F.count("*").alias("dates"), F.avg("mean_return").alias("average_return"))


def quantile_cumulative(daily: DataFrame) -> DataFrame:
    w = Window.partitionBy("bucket").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("mean_return")
    x = F.when(x <= -1, F.raise_error(F.lit("a bucket lost all: no cumulative return")).cast("double")).otherwise(x)
    return daily.select("date", "bucket", (F.product(1 + x).over(w) - 1).alias("cumulative_return"))


def quantile_spread(daily: DataFrame) -> DataFrame:
    """Highest less lowest bucket that a date has, where it has two."""
    return daily.groupBy("date").agg(F.when(F.count("*") >= 2, F.max_by("mean_return", "bucket") - F.min_by("mean_return", "bucket")).alias("spread"))


def spread_summary(spread: DataFrame) -> DataFrame:
    x = F.col("spread")
    return spread.agg(F.avg(x).alias("mean_spread"), F.stddev_samp(x).alias("spread_std"), F.avg((x > 0).cast("double")).alias("positive_ratio"), F.avg((x < 0).cast("double")).alias("negative_ratio"), F.max_by(x, F.when(x.isNotNull(), F.col("date"))).alias("latest_spread"))


def coverage(panel: DataFrame, signal: str, label: str, group: str | None = None) -> DataFrame:
    d = panel.where(F.col(group).isNotNull()) if group else panel
    s, f = F.col(signal).isNotNull(), F.col(label).isNotNull()
    return d.groupBy("date", *([group] if group else [])).agg(F.count("*").alias("total"), F.count_if(s).alias("signals"), F.count_if(f).alias("labels"), F.count_if(s & f).alias("usable"))


def coverage_summary(cover: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    t = F.sum("total")
    return cover.groupBy(*keys).agg(t.alias("total"), F.sum("usable").alias("usable"), (F.sum("signals") / t).alias("signal_coverage"), (F.sum("labels") / t).alias("label_coverage"), (F.sum("usable") / t).alias("joint_coverage"), F.avg("usable").alias("average_usable"), F.min("usable").alias("min_usable"))


def market_summary(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def quality_summary(panel: DataFrame) -> DataFrame:
    s = panel.groupBy("symbol").count().agg(F.min("count").alias("min_rows_per_symbol"), F.avg("count").alias("avg_rows_per_symbol"), F.max("count").alias("max_rows_per_symbol"))
    d = panel.groupBy("date").count().agg(F.min("count").alias("min_symbols_per_date"), F.avg("count").alias("avg_symbols_per_date"), F.max("count").alias("max_symbols_per_date"))
    return s.join(d)  # one row each


def reason_histogram(panel: DataFrame) -> DataFrame:
    return panel.where("universe_exclusion_reason <> ''").select(F.explode(F.split("universe_exclusion_reason", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def universe_summary(panel: DataFrame) -> DataFrame:
    d = panel.groupBy("date").agg(F.count_if("is_universe_eligible").alias("e"))
    rows = panel.agg(F.count("*").alias("rows"), F.count_if("is_universe_eligible").alias("eligible_rows"), F.count_distinct(F.when(F.col("is_universe_eligible"), F.col("symbol"))).alias("symbols_ever_eligible"))
    return rows.join(d.agg(F.min("e").alias("min_per_date"), F.avg("e").alias("avg_per_date"), F.max("e").alias("max_per_date")))

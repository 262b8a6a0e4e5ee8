"""The universe filter: lagged tradability rules and their reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel import full, rolling, sym
from .asof import listing_days, slug


@dataclass(frozen=True)
class UniverseRules:
    min_price: float | None = None
    min_average_volume: float | None = None
    average_volume_window: int = 20
    min_average_dollar_volume: float | None = None
    dollar_volume_window: int = 20
    min_listing_days: int | None = None
    memberships: tuple[str, ...] = ()
    require_tradable: bool = False
    lag: int = 1


def apply_universe(df: DataFrame, rules: UniverseRules, sessions: DataFrame | None = None) -> DataFrame:
    """Listing history counts sessions from the listing date where the panel has one (of
    the calendar, or of the panel), else rows. Adds each rule's lagged value and passes_* flag, is_universe_eligible and
    universe_exclusion_reason (';'-joined, in the order of the rules). A missing
    value passes nothing. All values are those of `lag` rows before."""
    w = sym()
    known = F.row_number().over(w) > rules.lag
    values: dict = {}
    tests: list = []  # (flag, value column, threshold, reason if missing, reason if below)
    lagged = lambda c: F.lag(c, rules.lag).over(w)
    if rules.min_listing_days is not None:
        df = listing_days(df, sessions)
        values["universe_listing_days"] = lagged("listing_history_days")
        tests.append(("passes_listing_history", "universe_listing_days", rules.min_listing_days, None, "insufficient_listing_history"))
    if rules.min_price is not None:
        values["universe_lagged_close"] = lagged("close")
        tests.append(("passes_min_price", "universe_lagged_close", rules.min_price, None, "below_min_price"))
    n = rules.average_volume_window
    if rules.min_average_volume is not None:
        df = df.withColumn("__av", full(F.avg("volume"), F.col("volume"), n, rolling(n)))
        values["universe_lagged_average_volume"] = lagged("__av")
        tests.append(("passes_min_average_volume", "universe_lagged_average_volume", rules.min_average_volume, "insufficient_average_volume_history", "below_min_average_volume"))
    m = rules.dollar_volume_window
    if rules.min_average_dollar_volume is not None:
        dv = F.col("close") * F.col("volume")
        df = df.withColumn("__adv", full(F.avg(dv), dv, m, rolling(m)))
        values["universe_lagged_average_dollar_volume"] = lagged("__adv")
        tests.append(("passes_min_average_dollar_volume", "universe_lagged_average_dollar_volume", rules.min_average_dollar_volume, "insufficient_adv_history", "below_min_average_dollar_volume"))
    flags = [("membership_" + slug(i), "passes_membership_" + slug(i), "missing_required_membership_" + slug(i), "not_member_" + slug(i)) for i in rules.memberships]
    if rules.require_tradable:
        flags.append(("trading_is_tradable", "passes_trading_status", "missing_trading_status", "not_tradable"))
    for column, *_ in flags:
        values["__l_" + column] = lagged(column)
    df = df.withColumns({"__known": known, **values})
    out, reasons, passed = {}, [F.when(~F.col("__known"), F.lit("insufficient_universe_history"))], F.col("__known")
    for flag, value, least, missing, below in tests:
        ok = F.coalesce(F.col(value) >= least, F.lit(False))
        out[flag] = ok
        if missing:
            reasons.append(F.when(F.col("__known") & F.col(value).isNull(), F.lit(missing)))
            reasons.append(F.when(F.col("__known") & (F.col(value) < least), F.lit(below)))
        else:
            reasons.append(F.when(F.col("__known") & ~ok, F.lit(below)))
        passed = passed & ok
    for column, flag, missing, no in flags:
        v = F.col("__l_" + column)
        out[flag] = F.coalesce(v, F.lit(False))
        reasons += [F.when(F.col("__known") & v.isNull(), F.lit(missing)), F.when(F.col("__known") & ~v, F.lit(no))]
        passed = passed & out[flag]
    out |= {"is_universe_eligible": passed, "universe_exclusion_reason": F.concat_ws(";", *reasons)}
    return df.withColumns(out).drop("__known", "__av", "__adv", "listing_history_days", *["__l_" + c for c, *_ in flags])


def mask_signal(df: DataFrame, signal: str) -> DataFrame:
    """The signal is missing where the row is not eligible (before any transform)."""
    return df.withColumn(signal, F.when(F.col("is_universe_eligible"), F.col(signal)))

"""As-of joins of effective-dated and release-dated records, and what derives from them.

A record becomes available on a session of the reference calendar: the first one on
or after its effective date, or strictly after its release date. It is valid until the
next record of its series becomes available, and a legitimate NULL of the newest record
wins over older values. Records are put among the rows of the panel and the last one
so far is carried forward by a window over the symbol, for all series at once: one
exchange by symbol, which the panel's other windows share, and work in proportion to
rows and records. Two records of a series that become available on one session are an
error of the action that reads the result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.panel import day


def slug(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def available_on(records: DataFrame, when: str, sessions: DataFrame, strict: bool) -> DataFrame:
    """records with available_date; those past the last session are dropped.

    Only distinct dates meet the calendar: both are merged and the next session is a
    window minimum over the (few) dates, then joined back by equality."""
    dates = records.select(F.col(when).alias("d")).distinct()
    both = dates.select("d", F.lit(None).cast("date").alias("s")).unionByName(sessions.select(F.col("date").alias("d"), F.col("date").alias("s")).distinct())
    w = Window.orderBy("d")  # one row a date: bounded by the calendar
    w = w.rangeBetween(Window.currentRow, Window.unboundedFollowing) if not strict else w
    if strict:
        days = both.withColumn("k", F.datediff("d", F.lit("1970-01-01").cast("date")))
        w = Window.orderBy("k").rangeBetween(1, Window.unboundedFollowing)
        both = days
    found = both.withColumn("available_date", F.min("s").over(w)).where("s is null and available_date is not null").select("d", "available_date")
    return records.join(found, records[when] == found["d"]).drop("d")


def attach(panel: DataFrame, records: DataFrame, values: dict[str, Column | str], when: str, sessions: DataFrame | None = None, strict: bool = False, series: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """panel with the values (output column -> expression over records) of the record
    that is valid on each row's date. With series (a column that tells series apart) and
    names (series -> output column), the one value is given for each series."""
    out = list(names.values()) if names else list(values)
    for c in out:
        if c in panel.columns:
            raise ValueError(f"column exists already: {c}")
    sessions = panel.select("date").distinct() if sessions is None else sessions
    if names:
        records = records.where(F.col(series).isin(*names))
    at = available_on(records.where(F.col("symbol").isNotNull()), when, sessions, strict)
    held = F.struct(*[(F.col(x) if isinstance(x, str) else x).alias(f"v{i}") for i, x in enumerate(values.values())])
    name = F.col(series).cast("string") if series else F.lit("")
    news = at.select("symbol", F.col("available_date").alias("date"), held.alias("__v"), name.alias("__n"))
    both = panel.unionByName(news, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("date", F.col("__n").asc_nulls_last())  # records of a date before its rows
    twice = F.lag(F.struct("date", "__n")).over(w) == F.struct("date", "__n")
    error = F.raise_error(F.concat(F.lit(f"records of {', '.join(out)} become available on the same session: "), F.col("symbol"), F.lit(" "), F.col("date").cast("string")))
    both = both.withColumn("__v", F.when(F.col("__n").isNotNull() & twice, error.cast(both.schema["__v"].dataType)).otherwise(F.col("__v")))
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda n: F.last(F.col("__v") if n is None else F.when(F.col("__n") == n, F.col("__v")), ignorenulls=True).over(past)
    found = {f"__l{k}": last(n) for k, n in enumerate(names or [None])}
    both = both.withColumns(found).where(F.col("__n").isNull())
    pick = [F.col("__l0")[f"v{i}"].alias(c) for i, c in enumerate(out)] if not names else [F.col(f"__l{k}")["v0"].alias(c) for k, c in enumerate(out)]
    return both.select(*[F.col(f"`{c}`") for c in panel.columns], *pick)


def attach_series(panel: DataFrame, records: DataFrame, name: str, names: list[str], value: str, prefix: str, when: str, sessions: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """One column for each named series of a long table (fundamentals, memberships)."""
    if not names:
        return panel
    if len({slug(n) for n in names}) < len(names):
        raise ValueError("names give the same column")
    return attach(panel, records, {value: value}, when, sessions, strict, name, {n: f"{prefix}_{slug(n)}" for n in names})


def attach_fundamentals(panel, fundamentals, metrics: list[str], sessions=None) -> DataFrame:
    return attach_series(panel, fundamentals, "metric_name", metrics, "metric_value", "fundamental", "release_date", sessions, strict=True)


def attach_memberships(panel, memberships, indexes: list[str], sessions=None) -> DataFrame:
    return attach_series(panel, memberships, "index_name", indexes, "is_member", "membership", "effective_date", sessions)


def attach_classifications(panel, records, fields=("sector", "industry"), sessions=None) -> DataFrame:
    return attach(panel, records, {f"classification_{f}": f for f in fields}, "effective_date", sessions)


def attach_borrow(panel, records, fields=("is_borrowable", "borrow_fee_bps"), sessions=None) -> DataFrame:
    names = {"is_borrowable": "borrow_is_borrowable", "borrow_fee_bps": "borrow_fee_bps"}
    return attach(panel, records, {names[f]: f for f in fields}, "effective_date", sessions)


def attach_trading_status(panel, records, fields=("is_tradable", "status_reason"), sessions=None) -> DataFrame:
    names = {"is_tradable": "trading_is_tradable", "status_reason": "trading_status_reason"}
    return attach(panel, records, {names[f]: f for f in fields}, "effective_date", sessions)


def attach_shares(panel, records, sessions=None) -> DataFrame:
    df = attach(panel, records, {"shares_outstanding": "shares_outstanding"}, "effective_date", sessions)
    return df.withColumn("market_cap", F.col("close") * F.col("shares_outstanding"))


def attach_symbol_metadata(panel: DataFrame, metadata: DataFrame) -> DataFrame:
    """listing and delisting dates; a row without metadata, before listing or after
    delisting is an error."""
    df = panel.join(metadata.select("symbol", "listing_date", "delisting_date"), "symbol", "left")
    bad = df.agg(
        F.count_if(F.col("listing_date").isNull()).alias("missing"),
        F.count_if(F.col("date") < F.col("listing_date")).alias("early"),
        F.count_if(F.col("date") > F.col("delisting_date")).alias("late"),
    ).first()
    for k, message in (("missing", "symbols without metadata"), ("early", "rows before listing"), ("late", "rows after delisting")):
        if bad[k]:
            raise ValueError(f"{message}: {bad[k]} rows")
    return df


def listing_days(panel: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """panel with listing_history_days: sessions from the listing date (its first session
    included) to the row's date; without listing dates, rows of the symbol so far. A
    row's date that is no session has none."""
    if "listing_date" not in panel.columns:
        return panel.withColumn("listing_history_days", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    sessions = (panel if sessions is None else sessions).select(F.col("date").alias("d")).distinct()
    days = sessions.select("d", F.lit(1).alias("s")).unionByName(panel.select(F.explode(F.array("date", "listing_date")).alias("d"), F.lit(0).alias("s")).distinct())
    w = Window.orderBy("d")  # one row a date: bounded by the calendar
    before = F.sum("s").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.max("s").over(Window.partitionBy("d"))
    at = days.withColumns({"n": before}).groupBy("d").agg(F.max("n").alias("n"), F.max("s").alias("s"))
    now = at.select(F.col("d").alias("__d"), F.when(F.col("s") == 1, F.col("n")).alias("__now"))
    first = at.select(F.col("d").alias("__f"), F.col("n").alias("__first"))
    df = panel.join(now, panel["date"] == now["__d"], "left").join(first, F.col("listing_date") == F.col("__f"), "left")
    return df.withColumn("listing_history_days", F.col("__now") - F.col("__first") + 1).drop("__d", "__now", "__f", "__first")


def growth_events(fundamentals: DataFrame) -> DataFrame:
    """symbol, metric_name, release_date, growth: current over prior period less 1, as
    an event of the current release. Pairs that are not valid give no event."""
    if fundamentals.groupBy("symbol", "metric_name", "period_end_date").count().where("count > 1").limit(1).collect():
        raise ValueError("restated periods: growth needs one release a period")
    w = Window.partitionBy("symbol", "metric_name").orderBy("period_end_date")
    df = fundamentals.withColumns({"__v": F.lag("metric_value").over(w), "__r": F.lag("release_date").over(w)})
    return df.where("__v > 0 AND __r <= release_date").select("symbol", "metric_name", "release_date", (F.col("metric_value") / F.col("__v") - 1).alias("growth"))


def attach_growth(panel, fundamentals, metrics: list[str], sessions=None) -> DataFrame:
    return attach_series(panel, growth_events(fundamentals), "metric_name", metrics, "growth", "growth", "release_date", sessions, strict=True)


def edge_positions(q: int) -> list[float]:
    """k / q for k = 0..q as the equal-width grid's doubles."""
    step = 1.0 / q
    return [k * step for k in range(q)] + [1.0]


def rank_bucket(rank: Column, n: Column, q: int) -> Column:
    """The bucket 1..q of rank 1..n: right-inclusive, on edges interpolated between ranks
    in double arithmetic (the integer formula differs where an edge is an ulp off)."""
    total = F.lit(0)
    r = rank.cast("double")
    for x in edge_positions(q):
        v = (n - 1).cast("double") * F.lit(x * 100 / 100)
        p = F.floor(v).cast("double")
        g = v - p
        a, b = p + 1, F.least(p + 2, n.cast("double"))
        edge = F.when(g < 0.5, a + (b - a) * g).otherwise(b - (b - a) * (1 - g))
        total = total + F.when(edge < r, 1).otherwise(0)
    return F.greatest(F.lit(1), total)


def market_cap_buckets(df: DataFrame, n_buckets: int, column: str = "market_cap", output: str = "market_cap_bucket") -> DataFrame:
    """Per date, quantile buckets of values (1 = smallest). A date with too few values,
    too few different ones or equal edges has none. Edges are interpolated between two
    ranked values each, by conditional aggregates; no array of a date is made."""
    if n_buckets < 2:
        raise ValueError("n_buckets must be at least 2")
    x = F.col(column)
    ranked = df.where(x.isNotNull()).select("date", x.alias("__x"))
    ranked = ranked.withColumns({"__r": F.row_number().over(day().orderBy("__x")), "__c": F.count("*").over(day())})
    picks = []
    for p in edge_positions(n_buckets):
        v = (F.col("__c") - 1).cast("double") * F.lit(p)
        low = F.floor(v)
        a = F.max(F.when(F.col("__r") == low + 1, F.col("__x")))
        b = F.max(F.when(F.col("__r") == F.least(low + 2, F.col("__c")), F.col("__x")))
        g = F.max(v - low)
        picks.append(F.when(g < 0.5, a + (b - a) * g).otherwise(b - (b - a) * (1 - g)))
    edges = ranked.groupBy("date").agg(F.count("*").alias("__n"), F.count_distinct("__x").alias("__d"), F.array(*picks).alias("__e"))
    j = df.join(edges, "date", "left")
    usable = x.isNotNull() & (F.col("__n") >= n_buckets) & (F.col("__d") >= n_buckets) & (F.size(F.array_distinct("__e")) == n_buckets + 1)
    bucket = F.greatest(F.lit(1), F.size(F.filter("__e", lambda v: v < x)))
    return j.withColumn(output, F.when(usable, bucket)).drop("__n", "__d", "__e")

"""Close-to-close backtest of target weights with delayed, limited and costed trades.

Weights do not drift. Three plans, by what the settings need:

1. no limit that depends on the executed weight: the executed weight is the last
   rebalance date's delayed target, a window over the symbol;
2. limits of a symbol alone (tradability, direction, caps, clips): a fold over the
   dates of each hash part of the symbols;
3. a turnover cap couples all symbols of a date: one fold over the dates of a run,
   parallel over the runs of a sweep.

The folds get only keys, targets, flags and caps, sorted by date, hold one date and one
weight a symbol at a time, and are joined back by run, date and symbol.

Flags, bps and caps that rows carry are checked where they are used: a missing or
invalid one is an error of the action that reads it, never a default.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import strict_flag


@dataclass(frozen=True)
class BacktestSettings:
    weight: str = "portfolio_weight"
    signal_delay: int = 1
    fill: str = "close"  # or next_close: one more row
    rebalance: str = "daily"  # weekly, monthly: the first observed date
    shortable: str | None = None
    tradable: str | None = None
    can_buy: str | None = None
    can_sell: str | None = None
    max_trade_weight: float | None = None
    max_trade_weight_column: str | None = None
    max_participation_rate: float | None = None
    participation_notional: float | None = None
    min_trade_weight: float = 0.0
    max_turnover: float | None = None
    transaction_cost_bps: float | None = None  # all costs in one; excludes the others
    commission_bps: float = 0.0
    slippage_bps: float = 0.0
    commission_bps_column: str | None = None
    slippage_bps_column: str | None = None
    liquidity_bucket: str | None = None
    slippage_bps_by_bucket: tuple[tuple[str, float], ...] = ()
    market_impact_bps_per_turnover: float = 0.0
    borrow_fee_bps: str | None = None
    initial_nav: float = 1.0

    def __post_init__(self):
        if self.signal_delay < 1 or self.fill not in ("close", "next_close") or self.rebalance not in ("daily", "weekly", "monthly"):
            raise ValueError("signal_delay >= 1, fill close or next_close, rebalance daily, weekly or monthly")
        if (self.max_participation_rate is None) != (self.participation_notional is None):
            raise ValueError("a participation rate needs a notional, and the reverse")
        split = (self.commission_bps, self.slippage_bps, self.market_impact_bps_per_turnover, self.commission_bps_column, self.slippage_bps_column, self.liquidity_bucket, self.slippage_bps_by_bucket)
        if self.transaction_cost_bps is not None and any(split):
            raise ValueError("transaction_cost_bps excludes commission, slippage and impact")
        if (self.commission_bps and self.commission_bps_column) or (self.slippage_bps and self.slippage_bps_column):
            raise ValueError("a cost is given in bps or by a column, not both")
        if bool(self.liquidity_bucket) != bool(self.slippage_bps_by_bucket):
            raise ValueError("a liquidity bucket column needs slippage by bucket, and the reverse")
        if self.liquidity_bucket and (self.slippage_bps or self.slippage_bps_column):
            raise ValueError("slippage by bucket excludes other slippage")
        buckets = [b for b, _ in self.slippage_bps_by_bucket]
        if len(set(buckets)) < len(buckets) or any(not b.strip() for b in buckets):
            raise ValueError("buckets must have different names")
        numbers = [self.commission_bps, self.slippage_bps, self.market_impact_bps_per_turnover, self.min_trade_weight, self.transaction_cost_bps, self.max_trade_weight, self.max_turnover, *(v for _, v in self.slippage_bps_by_bucket)]
        if any(x is not None and not 0 <= x < float("inf") for x in numbers):
            raise ValueError("costs and limits must be finite and not negative")
        if not 0 < self.initial_nav < float("inf") or any(x is not None and not 0 < x < float("inf") for x in (self.max_participation_rate, self.participation_notional)):
            raise ValueError("initial_nav, participation rate and notional must be positive")

    @property
    def delay(self) -> int:
        return self.signal_delay + (self.fill == "next_close")

    @property
    def per_symbol(self) -> bool:
        return any(x is not None for x in (self.tradable, self.can_buy, self.can_sell, self.max_trade_weight, self.max_trade_weight_column, self.max_participation_rate)) or self.min_trade_weight > 0


def rebalance_flags(df: DataFrame, rebalance: str) -> DataFrame:
    if rebalance == "daily":
        return df.withColumn("is_rebalance_date", F.lit(True))
    period = F.date_trunc("week" if rebalance == "weekly" else "month", "date")
    first = df.select("date").distinct().groupBy(period.alias("__p")).agg(F.min("date").alias("date")).select("date", F.lit(True).alias("__first"))
    return df.join(first, "date", "left").withColumn("is_rebalance_date", F.coalesce("__first", F.lit(False))).drop("__first")


def _flag(column: str | None) -> Column:
    """A row's flag (bool, 0 or 1, true or false in any case); anything else is an error."""
    if not column:
        return F.lit(True)
    return F.coalesce(strict_flag(F.col(column)), F.raise_error(F.lit(f"missing or invalid flag in {column}")).cast("boolean"))


def _amount(column: str) -> Column:
    """A row's bps or cap: finite and not negative; anything else is an error."""
    x = F.expr(f"try_cast(`{column}` AS double)")
    good = x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    return F.when(good, x).otherwise(F.raise_error(F.lit(f"missing, invalid or negative value in {column}")).cast("double"))


_OUT = ["executed_weight", "previous_effective_weight"]
_LIMITS = ["tradability_limit_applied", "buy_limit_applied", "sell_limit_applied", "participation_limit_applied", "trade_limit_applied", "trade_clip_applied", "turnover_limit_applied"]


def limit_trades(prev, target, reb, tradable, buy, sell, cap, part, s_min: float, s_turnover: float | None) -> tuple[np.ndarray, dict]:
    """Executed weights of one date (arrays over symbols) and which limits applied."""
    none = np.zeros(len(prev), bool)
    if not reb:
        return prev.copy(), dict.fromkeys(_LIMITS, none)
    held = ~tradable & (target != prev)
    want = np.where(held, prev, target)
    b, s = (want > prev) & ~buy, (want < prev) & ~sell
    want = np.where(b | s, prev, want)
    trade = want - prev
    p = (np.abs(trade) > part) & (part <= cap)
    most = np.minimum(cap, part)
    t = np.abs(trade) > most
    trade = np.clip(trade, -most, most)
    c = (trade != 0) & (np.abs(trade) < s_min)
    trade = np.where(c, 0.0, trade)
    total = np.abs(trade).sum()
    limited = s_turnover is not None and total > s_turnover
    if limited:
        trade = trade * (s_turnover / total)
    return prev + trade, dict(zip(_LIMITS, (held, b, s, p, t, c, np.full(len(prev), limited)), strict=True))


def _fold(s: BacktestSettings, own: list[str]):
    """Executed weights of rows that come sorted by run, date and symbol."""
    names = [*own, "date", "symbol"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        held = None

        def dates(t: pa.Table, final: bool):
            """Results of the whole dates at the front, and the rest."""
            if not t.num_rows:
                return [], t
            keys = [t.column(c).combine_chunks() for c in (*own, "date")]
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for k in keys:
                code = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], t.num_rows]
            n = len(starts) if final else len(starts) - 1
            out = []
            if n:
                cols = {c: t.column(c).to_numpy() for c in ("__t", "is_rebalance_date", "__tradable", "__buy", "__sell", "__cap", "__part")}
                runs = t.column(own[0]).to_pylist() if own else None
                symbols = t.column("symbol").to_pylist()
                for a, e in zip(starts[:n], ends[:n], strict=True):
                    if own and state.get("run", runs[a]) != runs[a]:
                        state.clear()
                    if own:
                        state["run"] = runs[a]
                    weights = state.setdefault("weights", {})
                    prev = np.array([weights.get(x, 0.0) for x in symbols[a:e]])
                    args = [cols[c][a:e] for c in ("__tradable", "__buy", "__sell", "__cap", "__part")]
                    w, flags = limit_trades(prev, cols["__t"][a:e], bool(cols["is_rebalance_date"][a]), *args, s.min_trade_weight, s.max_turnover)
                    weights.update(zip(symbols[a:e], w.tolist(), strict=True))
                    out.append([w, prev, *(flags[k] for k in _LIMITS)])
            return out, t.slice(int(ends[n - 1]) if n else 0)

        def batch(t: pa.Table, found: list) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            rows = t.select(names).slice(0, len(columns[0]))
            for name, c in zip([*_OUT, *_LIMITS], columns, strict=True):
                rows = rows.append_column(name, pa.array(c))
            return rows.combine_chunks().to_batches()[0]

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            found, held = dates(t, False)
            if found:
                yield batch(t, found)
        if held is not None and held.num_rows:
            yield batch(held, dates(held, True)[0])

    return run


def backtest_panel(df: DataFrame, s: BacktestSettings, run_id: str | None = None) -> DataFrame:
    """Per row: delayed target, executed weight, trade, limits applied, contributions.
    run_id: a column that tells independent runs apart (sweeps)."""
    own = [run_id] if run_id else []
    w = Window.partitionBy(*own, "symbol").orderBy("date")
    df = rebalance_flags(df, s.rebalance)
    df = df.withColumns({
        "asset_return": F.col("close") / F.lag("close").over(w) - 1,
        "delayed_target_weight": F.coalesce(F.lag(F.coalesce(F.col(s.weight), F.lit(0.0)), s.delay).over(w), F.lit(0.0)),
    })
    short_block = ~_flag(s.shortable) & (F.col("delayed_target_weight") < 0)  # the flag first: it is checked on every row
    df = df.withColumns({"__t": F.when(short_block, 0.0).otherwise(F.col("delayed_target_weight")), "short_availability_limit_applied": short_block & F.col("is_rebalance_date")})
    if not s.per_symbol and s.max_turnover is None:
        executed = F.coalesce(F.last(F.when(F.col("is_rebalance_date"), F.col("__t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
        df = df.withColumn("executed_weight", executed)
        df = df.withColumns({"previous_effective_weight": F.coalesce(F.lag("executed_weight").over(w), F.lit(0.0)), **{k: F.lit(False) for k in _LIMITS}}).drop("__t")
    else:
        inf = F.lit(float("inf"))
        cap = F.least(F.lit(float(s.max_trade_weight)) if s.max_trade_weight is not None else inf, _amount(s.max_trade_weight_column) if s.max_trade_weight_column else inf)
        part = F.col("close") * F.col("volume") * s.max_participation_rate / s.participation_notional if s.max_participation_rate is not None else inf
        df = df.withColumns({"__tradable": _flag(s.tradable), "__buy": _flag(s.can_buy), "__sell": _flag(s.can_sell), "__cap": cap, "__part": part})
        keys = [*own, "date", "symbol"]
        lean = df.select(*keys, "__t", "is_rebalance_date", "__tradable", "__buy", "__sell", "__cap", "__part")
        if s.max_turnover is None:
            lean = lean.repartition(*[F.col(c) for c in (*own, "symbol")])
        else:
            lean = lean.repartition(*map(F.col, own)) if own else lean.repartition(1)
        kinds = dict(df.dtypes)
        schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"{k} double" for k in _OUT] + [f"{k} boolean" for k in _LIMITS])
        folded = lean.sortWithinPartitions(*keys).mapInArrow(_fold(s, own), schema)
        df = df.drop("__t", "__tradable", "__buy", "__sell", "__cap", "__part").join(folded, keys)
    x, prev, target = F.col("executed_weight"), F.col("previous_effective_weight"), F.col("delayed_target_weight")
    df = df.withColumns({
        "desired_weight_change": target - prev, "weight_change": x - prev, "target_effective_weight_gap": target - x,
        "gross_return_contribution": x * F.coalesce("asset_return", F.lit(0.0)),
    })
    turn = F.abs("weight_change")
    rate = lambda c, v: _amount(c) if c else F.lit(float(v))
    slip = rate(s.slippage_bps_column, s.slippage_bps)
    if s.liquidity_bucket:
        known = F.create_map(*[F.lit(v) for b, v in s.slippage_bps_by_bucket for v in (b.strip(), float(v))])
        bucket = F.trim(F.col(s.liquidity_bucket).cast("string"))
        slip = F.coalesce(F.try_element_at(known, F.coalesce(bucket, F.lit(""))), F.raise_error(F.lit(f"missing or unmapped bucket in {s.liquidity_bucket}")).cast("double"))
    borrow = F.greatest(-x, F.lit(0.0)) * _amount(s.borrow_fee_bps) / 1e4 / 252 if s.borrow_fee_bps else F.lit(0.0)
    commission = s.commission_bps if s.transaction_cost_bps is None else s.transaction_cost_bps
    return df.withColumns({
        "commission_cost_contribution": turn * rate(s.commission_bps_column, commission) / 1e4,
        "slippage_cost_contribution": turn * slip / 1e4,
        "market_impact_cost_contribution": turn * (s.market_impact_bps_per_turnover * turn) / 1e4,
        "borrow_cost_contribution": borrow,
    })


def daily_results(panel: DataFrame, s: BacktestSettings, run_id: str | None = None) -> DataFrame:
    """One row a date (and run): returns, turnover, costs, exposures, limits, NAVs. The
    running product is over dates, one row each."""
    x, t = F.col("executed_weight"), F.col("delayed_target_weight")
    own = [run_id] if run_id else []
    costs = ["commission_cost", "slippage_cost", "market_impact_cost", "borrow_cost"]
    d = panel.groupBy(*own, "date").agg(
        F.sum("gross_return_contribution").alias("gross_return"), F.sum(F.abs("desired_weight_change")).alias("target_turnover"), F.sum(F.abs("weight_change")).alias("turnover"),
        *[F.sum(c + "_contribution").alias(c) for c in costs],
        F.sum(F.abs(x)).alias("gross_exposure"), F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("short_exposure"), F.sum(x).alias("net_exposure"),
        F.sum(F.abs(t)).alias("gross_target_exposure"), F.sum(t).alias("target_net_exposure"),
        F.count_if(x != 0).alias("holdings_count"), F.count_if(t != 0).alias("target_holdings_count"),
        F.sum(F.abs("target_effective_weight_gap")).alias("target_effective_weight_gap"),
        *[F.max(c).alias(c) for c in ("is_rebalance_date", "short_availability_limit_applied", *_LIMITS)],
    )
    d = d.withColumn("transaction_cost", sum((F.col(c) for c in costs), F.lit(0.0))).withColumn("net_return", F.col("gross_return") - F.col("transaction_cost"))
    w = Window.partitionBy(*own).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumns({f"{k}_nav": s.initial_nav * F.product(1 + F.col(f"{k}_return")).over(w) for k in ("gross", "net")})


def run_backtest(df: DataFrame, s: BacktestSettings, run_id: str | None = None) -> DataFrame:
    return daily_results(backtest_panel(df, s, run_id), s, run_id)


def orders(panel: DataFrame, least: float = 0.0) -> DataFrame:
    """Desired, executed and unfilled trades of which one exceeds the threshold."""
    want, done = F.col("desired_weight_change"), F.col("weight_change")
    left = want - done
    side = F.when(want > 0, "buy").when(want < 0, "sell").otherwise("hold")
    out = panel.select("date", "symbol", side.alias("side"), F.col("previous_effective_weight").alias("start_weight"), F.col("delayed_target_weight").alias("target_weight"), want.alias("desired_trade"), done.alias("executed_trade"), left.alias("unfilled_trade"))
    return out.where((F.abs("desired_trade") > least) | (F.abs("executed_trade") > least) | (F.abs("unfilled_trade") > least))


def ledger(panel: DataFrame, least: float = 0.0) -> DataFrame:
    """Start, trade and end weights of positions, their contribution and borrow cost."""
    x, prev = F.col("executed_weight"), F.col("previous_effective_weight")
    side = F.when(x > 0, "long").when(x < 0, "short").otherwise("flat")
    trade = F.when(F.col("weight_change") > 0, "buy").when(F.col("weight_change") < 0, "sell").otherwise("hold")
    out = panel.select("date", "symbol", side.alias("position_side"), trade.alias("trade_side"), prev.alias("start_weight"), F.col("weight_change").alias("trade_weight"), x.alias("end_weight"), "gross_return_contribution", "borrow_cost_contribution")
    return out.where((F.abs("start_weight") > least) | (F.abs("end_weight") > least))


def attach_benchmark(daily: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Excess (arithmetic) and relative (geometric) returns and NAVs; dates must match."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    j = daily.join(benchmark.select("date", "benchmark_return"), "date").withColumns({
        "excess_return": F.col("net_return") - F.col("benchmark_return"),
        "relative_return": (1 + F.col("net_return")) / (1 + F.col("benchmark_return")) - 1,
    })
    return j.withColumns({"benchmark_nav": F.product(1 + F.col("benchmark_return")).over(w), "relative_nav": F.product(1 + F.col("relative_return")).over(w)})

"""Validation errors, folds against the vector plan, and cases with known answers."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import asof as J
from tessera.operators import features as X
from tessera.operators import portfolio as P
from tessera.operators import transforms as T
from tessera.operators.backtest import BacktestSettings, backtest_panel, limit_trades, run_backtest
from tessera.operators.universe import UniverseRules, apply_universe
from tessera.plans.experiments import folds, rank_runs, sweep, validate_sweep, validate_walk_forward, walk_forward
from tessera.sources.tables import DataValidationError, dates_on_calendar, load, split_adjust, validate

DAY0 = dt.date(2024, 1, 2)
BARS = "date date, symbol string, open double, high double, low double, close double, volume double"


def bars(spark, prices: dict[str, list[float]], volume=100.0):
    rows = [(DAY0 + dt.timedelta(i), s, p, p + 1, p - 1, p, volume) for s, ps in prices.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, BARS)


def good(**change):
    return {"date": "2024-01-02", "symbol": " A ", "open": "10", "high": "11", "low": "9", "close": "10", "volume": "5", **change}


def test_load_csv_and_parquet(spark, tmp_path):
    pd.DataFrame([good(extra="x"), good(date="2024-01-03")]).to_csv(tmp_path / "a.csv", index=False)
    df = load(spark, f"{tmp_path}/a.csv", "ohlcv")
    assert df.columns == ["date", "symbol", "open", "high", "low", "close", "volume", "extra"] and df.first().symbol == "A"
    df.write.parquet(f"{tmp_path}/b.parquet")
    assert load(spark, f"{tmp_path}/b.parquet", "ohlcv").count() == 2
    with pytest.raises(ValueError, match="only .csv"):
        load(spark, "x.json", "ohlcv")


@pytest.mark.parametrize(
    "rows, message",
    [
        ([good(close="abc")], "close has missing"), ([good(close="nan")], "close has missing"), ([good(date="2024-01-02 10:00")], "date has missing"), ([good(symbol=" ")], "symbol has missing"),
        ([good(open="-1", low="-2")], "positive"), ([good(volume="-1")], "volume"), ([good(high="8", low="9", open="9", close="9")], "below low"), ([good(open="12")], "open must"), ([good(close="8")], "close must"), ([good(), good()], "duplicate"),
    ],
)
def test_bad_bars(spark, rows, message):
    with pytest.raises(DataValidationError, match=message):
        validate(spark.createDataFrame(pd.DataFrame(rows)), "ohlcv")


@pytest.mark.parametrize(
    "kind, row, message",
    [
        ("benchmark", {"date": "2024-01-02", "benchmark_return": "-1"}, "above -1"),
        ("symbol_metadata", {"symbol": "A", "listing_date": "2024-01-02", "delisting_date": "2023-01-01"}, "precede"),
        ("corporate_actions", {"symbol": "A", "ex_date": "2024-01-02", "action_type": "Split", "split_ratio": "0"}, "positive split_ratio"),
        ("corporate_actions", {"symbol": "A", "ex_date": "2024-01-02", "action_type": "merger"}, "must be split"),
        ("corporate_actions", {"symbol": "A", "ex_date": "2024-01-02", "action_type": "cash_dividend", "cash_amount": "1", "split_ratio": "2"}, "no split_ratio"),
        ("fundamentals", {"symbol": "A", "period_end_date": "2024-01-02", "release_date": "2024-01-01", "metric_name": "m", "metric_value": "1"}, "precede"),
        ("shares_outstanding", {"symbol": "A", "effective_date": "2024-01-02", "shares_outstanding": "0"}, "positive"),
        ("memberships", {"symbol": "A", "effective_date": "2024-01-02", "index_name": "X", "is_member": "yes"}, "is_member has"),
        ("borrow_availability", {"symbol": "A", "effective_date": "2024-01-02", "is_borrowable": "1", "borrow_fee_bps": "-1"}, "not negative"),
        ("trading_status", {"symbol": "A", "effective_date": "2024-01-02"}, "missing column is_tradable"),
    ],
)
def test_bad_reference_tables(spark, kind, row, message):
    with pytest.raises(DataValidationError, match=message):
        validate(spark.createDataFrame([row]), kind)


def test_optional_values_and_calendar(spark):
    row = {"symbol": "A", "effective_date": "2024-01-02", "is_tradable": " TRUE ", "status_reason": " "}
    got = validate(spark.createDataFrame([row]), "trading_status").first()
    assert got.is_tradable is True and got.status_reason is None
    with pytest.raises(DataValidationError, match="2024-01-03"):
        dates_on_calendar(bars(spark, {"A": [10.0, 11.0]}), spark.createDataFrame([(DAY0,)], "date date"))


def test_split_adjustment(spark):
    actions = spark.createDataFrame([("A", DAY0 + dt.timedelta(2), "split", 2.0), ("A", DAY0 + dt.timedelta(3), "split", 5.0), ("A", DAY0, "cash_dividend", None)], "symbol string, ex_date date, action_type string, split_ratio double")
    got = split_adjust(bars(spark, {"A": [10.0] * 5, "B": [10.0]}), actions).orderBy("symbol", "date").collect()
    assert [round(r.close, 9) for r in got] == [1.0, 1.0, 2.0, 10.0, 10.0, 10.0] and [r.volume for r in got][:3] == [1000.0, 1000.0, 500.0]


def test_constant_window_moments_and_overwrite(spark):
    df = X.returns(bars(spark, {"A": [10.0] * 8}))
    last = X.higher_moments(df, 5).orderBy("date").collect()[-1]
    assert (last.rolling_skewness_5d, last.rolling_kurtosis_5d) == (0.0, -3.0)
    with pytest.raises(ValueError, match="exist already"):
        X.returns(df)


def test_asof_newest_null_wins_and_strictness(spark):
    records = spark.createDataFrame([("A", DAY0, 5.0), ("A", DAY0 + dt.timedelta(2), None), ("A", DAY0 + dt.timedelta(9), 1.0)], "symbol string, effective_date date, v double")
    panel = bars(spark, {"A": [10.0] * 5})
    get = lambda strict: [r.out for r in J.attach(panel, records, {"out": "v"}, "effective_date", strict=strict).orderBy("date").collect()]
    assert get(False) == [5.0, 5.0, None, None, None] and get(True) == [None, 5.0, 5.0, None, None]


def test_memberships_gate_the_universe(spark):
    members = spark.createDataFrame([("A", DAY0, "S&P 500", True), ("B", DAY0, "S&P 500", False)], "symbol string, effective_date date, index_name string, is_member boolean")
    df = J.attach_memberships(bars(spark, {"A": [10.0] * 3, "B": [10.0] * 3, "C": [10.0] * 3}), members, ["S&P 500"])
    got = {(r.symbol, r.date): r.universe_exclusion_reason for r in apply_universe(df, UniverseRules(memberships=("S&P 500",))).collect()}
    d = DAY0 + dt.timedelta(1)
    assert got["A", DAY0] == "insufficient_universe_history" and got["A", d] == "" and got["B", d] == "not_member_s_p_500" and got["C", d] == "missing_required_membership_s_p_500"


@pytest.mark.parametrize("q", [2, 3, 4, 5, 10])
def test_rank_buckets_equal_interpolated_cuts(spark, q):
    sizes = list(range(q, 60)) + [91, 171, 181]
    df = spark.createDataFrame([(n, r) for n in sizes for r in range(1, n + 1)], "n int, r int")
    got = {}
    for x in df.select("n", "r", J.rank_bucket(F.col("r"), F.col("n"), q).alias("b")).collect():
        got.setdefault(x.n, {})[x.r] = x.b
    for n in sizes:
        want = pd.qcut(pd.Series(range(1, n + 1)), q, labels=False) + 1
        assert [got[n][r] for r in range(1, n + 1)] == want.tolist(), (q, n)


def test_waterfill_equals_a_loop(spark):
    rng = random.Random(3)
    prices = {f"S{i}": [10.0] for i in range(12)}
    caps = {s: rng.choice([0.02, 0.05, 0.2, 0.5]) for s in prices}
    scores = {s: rng.random() for s in prices}
    df = bars(spark, prices).withColumns({"score": F.create_map(*[F.lit(v) for p in scores.items() for v in p])[F.col("symbol")], "cap": F.create_map(*[F.lit(v) for p in caps.items() for v in p])[F.col("symbol")]})
    got = {r.symbol: r.portfolio_weight for r in P.long_only(df, "score", 9, "score", cap_column="cap").collect()}
    chosen = sorted(scores, key=lambda s: -scores[s])[:9]
    least = min(scores[s] for s in chosen)
    strength, weight, left = {s: scores[s] - least + 1 for s in chosen}, dict.fromkeys(chosen, 0.0), 1.0
    free = set(chosen)
    while free and left > 1e-15:
        total = sum(strength[s] for s in free)
        over = [s for s in free if left * strength[s] / total >= caps[s]]
        if not over:
            weight.update({s: left * strength[s] / total for s in free})
            break
        for s in over:
            weight[s] = caps[s]
            free.discard(s)
        left = 1 - sum(weight[s] for s in chosen if s not in free)
    assert all(abs(got[s] - weight.get(s, 0.0)) < 1e-12 for s in scores)


def test_folds_equal_the_vector_plan(spark):
    rng = random.Random(1)
    df = bars(spark, {s: [10 + rng.random() for _ in range(12)] for s in "ABCD"}).withColumn("portfolio_weight", F.rand(5) - 0.5)
    df = df.where(F.rand(7) < 0.8).cache()
    base = BacktestSettings(rebalance="weekly")
    key = lambda p: sorted((r.date, r.symbol, round(r.executed_weight, 12)) for r in p.collect())
    want = key(backtest_panel(df, base))
    assert key(backtest_panel(df, BacktestSettings(rebalance="weekly", max_trade_weight=99.0))) == want
    assert key(backtest_panel(df, BacktestSettings(rebalance="weekly", max_turnover=99.0))) == want


def test_limits_in_order():
    t = np.array
    w, f = limit_trades(t([0.0, 0.2, 0.1]), t([0.5, 0.0, 0.15]), True, t([True, False, True]), t([True] * 3), t([True] * 3), t([np.inf] * 3), t([0.3, np.inf, np.inf]), 0.1, 0.2)
    assert np.allclose(w, [0.2, 0.2, 0.1]) and f["participation_limit_applied"].tolist() == [True, False, False]
    assert f["tradability_limit_applied"].tolist() == [False, True, False] and f["trade_clip_applied"].tolist() == [False, False, True] and f["turnover_limit_applied"].all()
    w, _ = limit_trades(t([0.3]), t([0.0]), False, t([True]), t([True]), t([True]), t([np.inf]), t([np.inf]), 0.0, None)
    assert w[0] == 0.3


def test_backtest_by_hand(spark):
    df = bars(spark, {"A": [100.0, 110.0, 99.0, 99.0]}).withColumn("portfolio_weight", F.lit(1.0))
    got = run_backtest(df, BacktestSettings(commission_bps=10)).orderBy("date").collect()
    assert [round(r.gross_return, 9) for r in got] == [0.0, 0.1, -0.1, 0.0] and [round(r.turnover, 9) for r in got] == [0, 1, 0, 0]
    assert round(got[-1].net_nav, 9) == round((1.1 - 0.001) * 0.9, 9)
    low = A.drawdowns(spark.createDataFrame([(DAY0, -0.5), (DAY0 + dt.timedelta(1), 0.1)], "date date, net_return double")).orderBy("date").collect()
    assert low[0].drawdown == 0.0


def test_null_groups_and_many_exposures(spark):
    df = bars(spark, {s: [float(i + 10)] for i, s in enumerate("ABCDEFG")}).withColumns({"g": F.when(F.col("symbol") < "D", "x"), "a": F.col("close") ** 2, "b": F.sqrt("close")})
    assert {r.symbol for r in T.zscore(df, "close", "g").where("close_zscore is not null").collect()} == set("ABC")
    got = T.residualize(df, "close", ["a", "b"]).orderBy("symbol").toPandas()
    x = np.column_stack([np.ones(7), got["a"], got["b"]])
    want = got["close"] - x @ np.linalg.lstsq(x, got["close"], rcond=None)[0]
    assert np.allclose(got["close_residualized"], want, atol=1e-9)
    with pytest.raises(ValueError, match="own|itself"):
        T.residualize(df, "close", ["close"])


def test_folds_and_run_ranks(spark):
    assert folds([1, 2, 3, 4, 5, 6, 7], 3, 2) == [([1, 2, 3], [4, 5]), ([3, 4, 5], [6, 7])]
    runs = spark.createDataFrame([("a", 2.0, None), ("b", 2.0, 1.0), ("c", 1.0, 3.0)], "run_id string, x double, y double")
    got = {r.run_id: (r.rank_x, r.rank_y, r.score) for r in rank_runs(runs, {"x": 1.0, "y": 3.0}).collect()}
    assert got == {"a": (1, 3, 2.5), "b": (1, 2, 1.75), "c": (3, 1, 1.5)}


def book(spark, **columns):
    return bars(spark, {"A": [10.0, 11.0, 12.0], "B": [10.0, 9.0, 8.0]}).withColumns({"portfolio_weight": F.when(F.col("symbol") == "A", 0.5).otherwise(-0.5), **columns})


@pytest.mark.parametrize("name, value", [("tradable", None), ("can_buy", "maybe"), ("can_sell", "2"), ("shortable", ""), ("shortable", None), ("tradable", "2")])
def test_flags_of_rows_are_strict(spark, name, value):
    df = book(spark, flag=F.lit(value).cast("string"))
    with pytest.raises(Exception, match="missing or invalid flag in flag"):
        run_backtest(df, BacktestSettings(**{name: "flag"})).collect()


def test_flags_may_be_text_or_numbers(spark):
    df = book(spark, a=F.lit("true"), b=F.lit(" FALSE "), c=F.lit(1), d=F.lit(0.0))
    got = run_backtest(df, BacktestSettings(tradable="a", can_buy="c", can_sell="b", shortable="d")).orderBy("date").collect()
    assert [round(r.gross_exposure, 9) for r in got] == [0.0, 0.5, 0.5]


@pytest.mark.parametrize("name, value", [("commission_bps_column", None), ("commission_bps_column", -5.0), ("slippage_bps_column", float("inf")), ("borrow_fee_bps", float("nan")), ("borrow_fee_bps", -1.0), ("max_trade_weight_column", "x"), ("max_trade_weight_column", None)])
def test_amounts_of_rows_are_strict(spark, name, value):
    df = book(spark, v=F.lit(value) if value is not None else F.lit(None).cast("double"))
    with pytest.raises(Exception, match="missing, invalid or negative value in v"):
        run_backtest(df, BacktestSettings(**{name: "v"})).collect()


def test_amounts_may_be_text(spark):
    s = BacktestSettings(commission_bps_column="v", slippage_bps_column="v", borrow_fee_bps="v", max_trade_weight_column="v")
    assert run_backtest(book(spark, v=F.lit("3")), s).agg(F.max("transaction_cost")).first()[0] == pytest.approx(6e-4 + 0.5 * 3e-4 / 252)


def test_liquidity_buckets(spark):
    s = BacktestSettings(liquidity_bucket="b", slippage_bps_by_bucket=(("high", 1.0), ("low", 9.0)))
    for bad in (None, " ", "other"):
        with pytest.raises(Exception, match="bucket in b"):
            run_backtest(book(spark, b=F.lit(bad).cast("string")), s).collect()
    got = run_backtest(book(spark, b=F.when(F.col("symbol") == "A", " high ").otherwise("low")), s).orderBy("date").collect()
    assert got[1].slippage_cost == pytest.approx(0.5 * 1e-4 + 0.5 * 9e-4)


def test_costs_exclude_each_other():
    for bad in ({"transaction_cost_bps": 1.0, "commission_bps": 1.0}, {"commission_bps": 1.0, "commission_bps_column": "c"}, {"liquidity_bucket": "b"}, {"slippage_bps": 1.0, "liquidity_bucket": "b", "slippage_bps_by_bucket": (("x", 1.0),)}, {"commission_bps": -1.0}, {"slippage_bps_by_bucket": (("x", 1.0), ("x", 2.0)), "liquidity_bucket": "b"}, {"initial_nav": 0.0}):
        with pytest.raises(ValueError):
            BacktestSettings(**bad)
    assert BacktestSettings(transaction_cost_bps=5.0).transaction_cost_bps == 5.0


def test_fold_over_runs_and_small_batches(spark):
    rng = random.Random(4)
    df = bars(spark, {s: [10 + rng.random() for _ in range(15)] for s in "ABCDE"}).withColumn("portfolio_weight", F.rand(5) - 0.5).cache()
    both = df.withColumn("run", F.lit("x")).unionByName(df.withColumn("run", F.lit("y")).withColumn("portfolio_weight", F.col("portfolio_weight") * 2))
    s = BacktestSettings(max_turnover=0.4, max_trade_weight=0.3)
    key = lambda p: sorted((r.date, round(r.turnover, 12), round(r.net_nav, 12)) for r in p.collect())
    want = key(run_backtest(df, s))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert key(run_backtest(df, s)) == want
        got = run_backtest(both, s, "run")
        assert key(got.where("run = 'x'")) == want and key(got.where("run = 'y'")) != want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("name", ["classifications", "borrow", "status", "shares", "memberships", "fundamentals"])
def test_records_of_one_session_are_an_error(spark, name):
    """Two records on days without bars become available on the same next session."""
    panel = bars(spark, {"A": [10.0] * 3}).unionByName(bars(spark, {"A": [10.0] * 9}).where(F.col("date") >= F.lit(DAY0 + dt.timedelta(7))))
    rows = [("A", DAY0 + dt.timedelta(4), 1), ("A", DAY0 + dt.timedelta(5), 2)]
    r = spark.createDataFrame(rows, "symbol string, effective_date date, n int").withColumns({
        "sector": F.lit("s"), "industry": F.lit("i"), "is_borrowable": F.lit(True), "borrow_fee_bps": F.lit(1.0), "is_tradable": F.lit(True), "status_reason": F.lit(""), "shares_outstanding": F.lit(1.0),
        "index_name": F.lit("X"), "is_member": F.lit(True), "metric_name": F.lit("m"), "metric_value": F.lit(1.0), "release_date": F.col("effective_date"),
    })
    join = {"classifications": J.attach_classifications, "borrow": J.attach_borrow, "status": J.attach_trading_status, "shares": J.attach_shares, "memberships": lambda p, x: J.attach_memberships(p, x, ["X"]), "fundamentals": lambda p, x: J.attach_fundamentals(p, x, ["m"])}[name]
    with pytest.raises(Exception, match="same session"):
        join(panel, r).collect()
    got = join(panel, r.where("n = 1"))
    assert got.count() == panel.count() and got.where(F.col(got.columns[7]).isNotNull()).count() == 2


def test_series_are_told_apart(spark):
    rows = [("A", DAY0, "x", 1.0), ("A", DAY0, "y", 2.0), ("A", DAY0 + dt.timedelta(1), "x", None), ("B", DAY0, "z", 9.0)]
    r = spark.createDataFrame(rows, "symbol string, release_date date, metric_name string, metric_value double")
    got = J.attach_fundamentals(bars(spark, {"A": [10.0] * 3, "B": [10.0] * 3}), r, ["x", "y"]).orderBy("symbol", "date").collect()
    assert [(x.fundamental_x, x.fundamental_y) for x in got] == [(None, None), (1.0, 2.0), (None, 2.0)] + [(None, None)] * 3


def test_listing_days_by_sessions(spark):
    panel = bars(spark, {"A": [10.0] * 4, "B": [10.0] * 4}).withColumn("listing_date", F.when(F.col("symbol") == "A", F.lit(DAY0 - dt.timedelta(3))).otherwise(F.lit(DAY0 + dt.timedelta(1))))
    calendar = spark.createDataFrame([(DAY0 + dt.timedelta(i),) for i in (-2, -1, 0, 1, 3)], "date date")
    get = lambda c: {(r.symbol, (r.date - DAY0).days): r.listing_history_days for r in J.listing_days(panel, c).collect()}
    got = get(calendar)
    assert [got["A", i] for i in range(4)] == [3, 4, None, 5] and [got["B", i] for i in range(4)] == [0, 1, None, 2]
    got = get(None)
    assert [got["A", i] for i in range(4)] == [1, 2, 3, 4] and [got["B", i] for i in range(4)] == [0, 1, 2, 3]
    flags = {(r.symbol, (r.date - DAY0).days): r.passes_listing_history for r in apply_universe(panel, UniverseRules(min_listing_days=4), calendar).collect()}
    assert flags["A", 2] and not flags["A", 1] and not flags["A", 3] and not flags["B", 3]


def test_caps_and_exposures_are_strict(spark):
    df = book(spark, score=F.col("close"))
    for cap in (F.lit(-0.1), F.lit("x")):
        with pytest.raises(Exception, match="cap in c"):
            P.long_only(df.withColumn("c", cap), "score", 1, cap_column="c").collect()
    assert P.long_only(df.withColumn("c", F.lit(None).cast("double")), "score", 1, cap_column="c").agg(F.sum("portfolio_weight")).first()[0] == 0
    for bad in ({"exposure": -1.0}, {"max_weight": 2.0}, {"max_weight": -0.1}, {"group": "symbol"}, {"top_n": 0}):
        with pytest.raises(ValueError):
            P.long_only(df, "score", **{"top_n": 1, **bad})
    inf = df.withColumns({"x": F.lit(float("inf")), "y": F.lit(1.0)})
    for bounds in ([P.ExposureBound("x", maximum=1.0)], [P.ExposureBound("x", maximum=1.0), P.ExposureBound("y", maximum=1.0)]):
        with pytest.raises(Exception, match="invalid number in x"):
            P.long_only(inf, "score", 1, bounds=bounds).collect()
    with pytest.raises(Exception, match="invalid number in x"):
        T.residualize(inf, "score", ["x"]).collect()


# The published sample panel's closes and the results published for it.
CLOSES = {
    "AAPL": [100.0, 101.0, 103.0, 104.0, 106.0, 108.0, 109.0, 111.0, 113.0, 115.0],
    "MSFT": [120.0, 119.0, 117.0, 116.0, 114.0, 112.0, 111.0, 109.0, 107.0, 106.0],
    "NFLX": [100.0, 97.0, 100.0, 97.0, 100.0, 97.0, 100.0, 97.0, 100.0, 97.0],
    "XOM": [90.0, 91.0, 91.5, 92.0, 93.0, 94.0, 95.0, 96.0, 97.0, 98.0],
}
SWEEP = {1: (-0.0748633668, -0.0794610039, -5.6926401216, 1.5, 0.4, -0.1830943295, -1.3132531742, 0.8), 2: (0.1159519698, 0.0, 20.7137192332, 0.1, 0.7, 0.6393658808, 4.9495208479, 0.7), 3: (0.1052267779, 0.0, 17.5667522046, 0.1, 0.6, 0.3314388932, None, 0.6)}
FOLDS = {1: (0.0092087379, 0.6224963929, 0.0384615385, 0.0, 1178.622077, 0.5896069414, 1.0), 2: (0.0480244586, 0.6060516671, 0.0277777778, 0.0, 34.0945416085, 0.7127219035, 1.0), 3: (0.0673076923, 0.6511644225, 0.0360360360, 0.0, 1257.196882, 0.6259106901, 0.5)}


@pytest.fixture(scope="module")
def sample(spark):
    days = [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9, 10, 11, 12, 15)]
    rows = [(d, s, c, c, c, c, 1.0) for s, cs in CLOSES.items() for d, c in zip(days, cs)]
    return X.forward_return(spark.createDataFrame(rows, BARS), 1)


def test_sweep_anchors(sample):
    got = sweep(sample, "momentum", "lookback", [1, 2, 3], BacktestSettings(transaction_cost_bps=5.0), 1, least=4)
    names = ("cumulative_return", "max_drawdown", "sharpe_ratio", "average_turnover", "hit_rate", "mean_ic", "ic_ir", "joint_coverage_ratio")
    for r in got.collect():
        assert (r.parameter_name, r.signal_column, r.construction) == ("lookback", f"momentum_signal_{r.parameter_value}d", "long_only")
        for n, want in zip(names, SWEEP[r.parameter_value]):
            assert want is None or r[n] == pytest.approx(want, abs=1e-9), n
    assert validate_sweep(got).count() == 3


def test_walk_forward_anchors(sample):
    got = walk_forward(sample, "momentum", "lookback", [1, 2, 3], BacktestSettings(transaction_cost_bps=5.0), 1, 4, 2, least=4)
    rows = {r.fold_index: r for r in got.collect()}
    names = ("train_cumulative_return", "train_mean_ic", "test_cumulative_return", "test_max_drawdown", "test_sharpe_ratio", "test_mean_ic", "test_joint_coverage_ratio")
    assert sorted(rows) == [1, 2, 3] and {r.selected_parameter_value for r in rows.values()} == {2}
    for k, r in rows.items():
        for n, want in zip(names, FOLDS[k]):
            assert r[n] == pytest.approx(want, rel=1e-8, abs=1e-9), (k, n)
    assert (rows[1].train_start, rows[1].train_end, rows[1].test_end) == (dt.date(2024, 1, 2), dt.date(2024, 1, 5), dt.date(2024, 1, 9))
    assert validate_walk_forward(got).count() == 3
    for bad in (got.drop("test_mean_ic"), got.withColumn("test_mean_ic", F.lit(None).cast("double")), got.withColumn("parameter_name", F.lit(" ")), got.limit(0)):
        with pytest.raises(DataValidationError):
            validate_walk_forward(bad)


def test_summaries_of_sources(spark):
    r = spark.createDataFrame([("A", DAY0, True, 1.0, "s", "i"), ("A", DAY0 + dt.timedelta(3), False, None, "s", "j"), ("B", DAY0, True, 2.0, None, None)], "symbol string, effective_date date, f boolean, x double, sector string, industry string")
    got = A.source_summary(r.withColumnsRenamed({"f": "is_borrowable", "x": "borrow_fee_bps"}), "borrow_availability").first()
    assert (got.rows, got.symbols, got.borrowable_rows, got.not_borrowable_rows, got.fee_observations) == (3, 2, 2, 1, 2)
    got = A.source_summary(r.withColumn("shares_outstanding", F.coalesce("x", F.lit(7.0))), "shares_outstanding").first()
    assert (got.rows, got.symbols, got.latest_shares_total) == (3, 2, 9.0)
    got = A.source_summary(r, "classifications").first()
    assert (got.sectors, got.industries, got.end_date) == (1, 2, DAY0 + dt.timedelta(3))


def test_a_bucket_that_lost_all_has_no_cumulative_return(spark):
    daily = spark.createDataFrame([(DAY0, 1, -1.0)], "date date, bucket int, mean_return double")
    with pytest.raises(Exception, match="lost all"):
        A.quantile_cumulative(daily).collect()


def test_volume_is_added_in_the_order_of_the_rows(spark, tmp_path, monkeypatch):
    """Two days that reach the least average volume of 60 in cents; in doubles the order decides."""
    import duckdb

    from tessera.plans import queries as Q

    monkeypatch.setitem(Q.ORACLE, "volume", Q.SQL + "SELECT date, volume FROM bars")
    cents = (8.2, 29.01, 22.06, 0.73)
    assert ((8.2 + 29.01) + 22.06) + 0.73 < 60 == (8.2 + 29.01) + (22.06 + 0.73)
    values = [(n, 0, 400.0) for n in range(1, 5)] + [(n, k, x) for n in (5, 6) for k, x in enumerate(cents)] + [(7, 0, 400.0)]
    rows = [(dt.datetime(2024, 1, n) + dt.timedelta(seconds=k), 7, "view", x) for n, k, x in values]
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)  # a task a file
    for name, key in (("parts", lambda r: r[0].second // 2), ("whole", lambda r: 0), ("reverse", lambda r: -r[0].second)):
        for k in sorted(set(map(key, rows))):
            part = spark.createDataFrame([r for r in rows if key(r) == k], "ts timestamp_ntz, user_id bigint, event_type string, value double")
            part.coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet/k={k + 50}")
        con = duckdb.connect(config={"threads": 1})
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/{name}/events.parquet/*/*.parquet'")
        rows_of = lambda q: sorted(con.execute(Q.ORACLE[q]).fetchall())  # noqa: E731, B023
        assert sorted(map(tuple, Q.panel(spark, f"{tmp_path}/{name}").select("date", "volume").collect())) == rows_of("volume")
        assert sorted(map(tuple, Q.QUERIES["universe"](spark, f"{tmp_path}/{name}").collect())) == rows_of("universe")
    spark.conf.unset("spark.sql.files.openCostInBytes")

"""Parameter sweeps and walk-forward selection. The candidates' weighted panels are
stacked under a run column, so a sweep is one backtest and one aggregation by run, and
folds only label its daily rows: a walk-forward run is one aggregation over (fold,
candidate) however many folds there are."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.analytics import coverage, coverage_summary, ic_series, ic_summary, performance
from ..operators.backtest import BacktestSettings, run_backtest
from ..operators.features import factor_signal
from ..operators.portfolio import long_only
from ..sources.tables import DataValidationError

RUN, SIGNAL = "__run", "__signal"
#: Result columns: fixed values of the files that sweeps and walk-forward runs write.
SWEEP_NUMBERS = ("parameter_value", "cumulative_return", "max_drawdown", "sharpe_ratio", "average_turnover", "hit_rate", "mean_ic", "ic_ir", "joint_coverage_ratio")
SWEEP_COLUMNS = ("parameter_name", "parameter_value", "signal_column", *SWEEP_NUMBERS[1:], "construction")
FOLD_NUMBERS = ("train_selection_score", "train_cumulative_return", "train_mean_ic", "test_cumulative_return", "test_max_drawdown", "test_sharpe_ratio", "test_mean_ic", "test_joint_coverage_ratio")
FOLD_COLUMNS = ("fold_index", "parameter_name", "selected_parameter_value", "signal_column", "selection_metric", "train_start", "train_end", "test_start", "test_end", *FOLD_NUMBERS)


def _stacked(panel: DataFrame, factor: str, parameter: str, values: list[int], fixed: dict, prepare: Callable | None, weights: Callable) -> tuple[DataFrame, DataFrame]:
    """All candidates' weighted panels under RUN, and RUN, value and signal of each."""
    if len(set(values)) < len(values) or not values:
        raise ValueError("values must be different, one at least")
    parts, names = [], []
    for k, v in enumerate(values):
        df, signal = factor_signal(panel, factor, **{**fixed, parameter: v})
        df, column = prepare(df, signal) if prepare else (df, signal)
        df = weights(df, column)
        new = [c for c in df.columns if c not in panel.columns and c not in (signal, column) and not c.startswith(signal + "_")]
        parts.append(df.select(F.lit(k).alias(RUN), F.col(column).alias(SIGNAL), *[F.col(f"`{c}`") for c in (*panel.columns, *new)]))
        names.append((k, v, column))
    runs = panel.sparkSession.createDataFrame(names, f"{RUN} int, value bigint, signal_column string")
    return reduce(DataFrame.unionByName, parts), runs


def _books(top_n: int, weights: Callable | None) -> Callable:
    return weights or (lambda df, signal: long_only(df, signal, top_n))


def sweep(panel: DataFrame, factor: str, parameter: str, values: list[int], settings: BacktestSettings, top_n: int, label: str = "forward_return_1d", least: int = 2, method: str = "pearson", prepare: Callable | None = None, weights: Callable | None = None, construction: str = "long_only", **fixed) -> DataFrame:
    """One row a value: performance, ICs and joint coverage. prepare: (panel, signal)
    -> (panel, signal) after the factor; weights: (panel, signal) -> panel, if not top_n."""
    stacked, runs = _stacked(panel, factor, parameter, values, fixed, prepare, _books(top_n, weights))
    perf = performance(run_backtest(stacked, settings, RUN), keys=(RUN,))
    ics = ic_summary(ic_series(stacked, SIGNAL, label, method, least, group=RUN), (RUN,)).select(RUN, "mean_ic", "ic_ir")
    cover = coverage_summary(coverage(stacked, SIGNAL, label, RUN), (RUN,)).select(RUN, F.col("joint_coverage").alias("joint_coverage_ratio"))
    out = perf.join(ics, RUN).join(cover, RUN).join(F.broadcast(runs), RUN)  # runs: one row a value
    return out.select(F.lit(parameter).alias("parameter_name"), F.col("value").alias("parameter_value"), "signal_column", *SWEEP_NUMBERS[1:], F.lit(construction).alias("construction"))


def rank_sweep(results: DataFrame, top: int = 3) -> DataFrame:
    return results.orderBy(F.desc_nulls_last("cumulative_return"), F.desc_nulls_last("sharpe_ratio"), F.desc_nulls_last("mean_ic"), "parameter_value").limit(top)


def folds(dates: list, train: int, test: int) -> list[tuple[list, list]]:
    """Rolling windows that step by `test`; a partial tail is dropped."""
    return [(dates[i : i + train], dates[i + train : i + train + test]) for i in range(0, len(dates) - train - test + 1, test)]


def walk_forward(panel: DataFrame, factor: str, parameter: str, values: list[int], settings: BacktestSettings, top_n: int, train: int, test: int, metric: str = "cumulative_return", label: str = "forward_return_1d", least: int = 2, method: str = "pearson", prepare: Callable | None = None, weights: Callable | None = None, **fixed) -> DataFrame:
    """Per fold, from 1: the value with the best train score (the first listed wins ties,
    a missing score loses) and its results on train and test dates."""
    if metric not in ("cumulative_return", "sharpe_ratio", "mean_ic"):
        raise ValueError("the metric is cumulative_return, sharpe_ratio or mean_ic")
    dates = [r[0] for r in panel.select("date").distinct().orderBy("date").collect()]  # one row a date
    parts = [(k, role, d) for k, (a, b) in enumerate(folds(dates, train, test), 1) for role, ds in (("train", a), ("test", b)) for d in ds]
    labels = panel.sparkSession.createDataFrame(parts, "fold_index bigint, role string, date date")
    stacked, runs = _stacked(panel, factor, parameter, values, fixed, prepare, _books(top_n, weights))
    daily = run_backtest(stacked, settings, RUN).select(RUN, "date", "net_return", "turnover")
    ics = ic_series(stacked, SIGNAL, label, method, least, group=RUN).select(RUN, "date", "ic")
    cover = coverage(stacked, SIGNAL, label, RUN).select(RUN, "date", "total", "usable")
    rows = daily.join(ics, [RUN, "date"], "left").join(cover, [RUN, "date"], "left").join(labels, "date")
    keys = ("fold_index", "role", RUN)
    perf = performance(rows, keys=keys).select(*keys, "cumulative_return", "max_drawdown", "sharpe_ratio")
    rest = rows.groupBy(*keys).agg(F.avg("ic").alias("mean_ic"), (F.sum("usable") / F.sum("total")).alias("joint"), F.min("date").alias("first"), F.max("date").alias("last"))
    scored = perf.join(rest, list(keys))
    w = Window.partitionBy("fold_index").orderBy(F.desc_nulls_last(metric), RUN)
    best = scored.where("role = 'train'").withColumn("o", F.row_number().over(w)).where("o = 1")
    best = best.select("fold_index", RUN, F.col("first").alias("train_start"), F.col("last").alias("train_end"), F.col(metric).alias("train_selection_score"), F.col("cumulative_return").alias("train_cumulative_return"), F.col("mean_ic").alias("train_mean_ic"))
    tests = scored.where("role = 'test'").select(
        "fold_index", RUN, F.col("first").alias("test_start"), F.col("last").alias("test_end"), F.col("cumulative_return").alias("test_cumulative_return"), F.col("max_drawdown").alias("test_max_drawdown"),
        F.col("sharpe_ratio").alias("test_sharpe_ratio"), F.col("mean_ic").alias("test_mean_ic"), F.col("joint").alias("test_joint_coverage_ratio"),
    )
    out = best.join(tests, ["fold_index", RUN]).join(F.broadcast(runs), RUN)
    out = out.withColumns({"parameter_name": F.lit(parameter), "selection_metric": F.lit(metric), "selected_parameter_value": F.col("value")})
    return out.select(*FOLD_COLUMNS)


def _validated(df: DataFrame, columns: tuple, numbers: tuple, source: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise DataValidationError(f"{source}: missing columns {missing}")
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    bad = {c: (number(c).isNull() | F.isnan(number(c))) if c in numbers else F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in columns}
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(x).alias(f"c{i}") for i, x in enumerate(bad.values())]).first()
    if not counted["rows"]:
        raise DataValidationError(f"{source}: no rows")
    for i, c in enumerate(bad):
        if counted[f"c{i}"]:
            raise DataValidationError(f"{source}: {c} has missing or invalid values")
    return df.select(*[number(c).alias(c) if c in numbers else F.col(c) for c in columns])


def validate_sweep(results: DataFrame) -> DataFrame:
    """The result columns of a sweep, or an error for missing columns, values or rows."""
    return _validated(results, tuple(c for c in SWEEP_COLUMNS if c != "construction"), SWEEP_NUMBERS, "sweep results")


def validate_walk_forward(results: DataFrame) -> DataFrame:
    """The result columns of a walk-forward run, or an error as for a sweep."""
    return _validated(results, FOLD_COLUMNS, ("fold_index", "selected_parameter_value", *FOLD_NUMBERS), "walk-forward results")


def rank_runs(runs: DataFrame, by: dict[str, float]) -> DataFrame:
    """Rank of each run by each metric (ties share the least rank, missing last) and
    the weighted mean rank."""
    total = sum(by.values())
    df = runs.withColumns({f"rank_{m}": F.rank().over(Window.orderBy(F.desc_nulls_last(m))) for m in by})
    return df.withColumn("score", sum((F.col(f"rank_{m}") * w for m, w in by.items()), F.lit(0.0)) / total)

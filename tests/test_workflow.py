"""Configuration, commands, bundles, run index, feature cache and charts on hand-made bars."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.operators import features as X
from tessera.operators import transforms as T
from tessera.plans import provenance as P
from tessera.plans import workflow as W
from tessera.sinks import artifacts, cache, comparison, reports

CONFIG = """
[data]
path = "bars.csv"
[benchmark]
path = "bench.csv"
rolling_window = 3
[dataset]
volatility_window = 2
average_volume_window = 2
benchmark_rolling_window = 3
yang_zhang_volatility_window = 3
[universe]
min_price = 5.0
[signal]
name = "momentum"
lookback = 2
[portfolio]
top_n = 1
weighting = "score"
max_position_weight = 0.6
[backtest]
rebalance_frequency = "weekly"
commission_bps = 2.0
max_turnover = 0.75
[diagnostics]
n_quantiles = 2
min_observations = 2
"""


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    d = tmp_path_factory.mktemp("flow")
    days = [f"2024-01-{n:02d}" for n in (2, 3, 4, 5, 8, 9, 10, 11, 12, 15)]
    rows = ["date,symbol,open,high,low,close,volume"]
    for k, s in enumerate("ABC"):
        for i, day in enumerate(days):
            c = 10 + k + (1 + k) * 0.3 * i - (k == 1) * 0.1 * (i % 3)
            rows.append(f"{day},{s},{c - 0.1:.3f},{c + 0.2:.3f},{c - 0.3:.3f},{c:.3f},{1000 + 10 * i}")
    (d / "bars.csv").write_text("\n".join(rows) + "\n")
    (d / "bench.csv").write_text("date,benchmark_return\n" + "".join(f"{x},0.00{i}\n" for i, x in enumerate(days)))
    (d / "run.toml").write_text(CONFIG)
    return d / "run.toml"


def test_config_is_strict(config, tmp_path):
    cfg = W.load_config(config)
    assert cfg["backtest"]["initial_nav"] == 1.0 and cfg["data"]["path"] == str(config.parent / "bars.csv")
    for text in ("[data]\npath='x'\nother=1", "[nothing]\n", "[data]\n", "[data]\npath='x'\n[dataset]\ninclude_market_cap=true", "not toml"):
        (tmp_path / "bad.toml").write_text(text)
        with pytest.raises(W.ConfigError):
            W.load_config(tmp_path / "bad.toml")


@pytest.mark.parametrize(
    "change, message",
    [
        ("min_observations = 2|min_observations = 1", "n_quantiles"), ("n_quantiles = 2|n_quantiles = 1", "n_quantiles"), ("n_quantiles = 2|n_quantiles = 2\nrolling_ic_window = 1", "rolling_ic"),
        ("n_quantiles = 2|n_quantiles = 2\nic_method = 'other'", "ic_method"), ("max_position_weight = 0.6|max_position_weight = 1.6", "exposure"), ("min_price = 5.0|average_volume_window = 3\nmin_price = 5.0", "average_volume"),
        ("min_price = 5.0|lag = 1", "universe"), ("commission_bps = 2.0|commission_bps = 2.0\ntransaction_cost_bps = 1.0", "excludes"), ("commission_bps = 2.0|commission_bps = -2.0", "negative"),
        ("commission_bps = 2.0|commission_bps = 2.0\ncommission_bps_column = 'x'", "not both"), ("commission_bps = 2.0|liquidity_bucket_column = 'x'", "bucket"), ("bars.csv|bars.json", "csv"), ("lookback = 2|clip_lower_bound = 0.1", "pairs"),
        ("volatility_window = 2|market_cap_bucket_count = 3", "needs"), ("name = \"momentum\"\nlookback = 2|name = \"trend\"\nshort_window = 9\nlong_window = 5", "short_window"),
    ],
)
def test_rules_between_options(tmp_path, change, message):
    old, new = change.split("|")
    assert old in CONFIG
    (tmp_path / "bad.toml").write_text(CONFIG.replace(old, new, 1))
    with pytest.raises(W.ConfigError, match=message):
        W.load_config(tmp_path / "bad.toml")


def test_benchmark_without_windows_has_default_statistics(spark, config):
    cfg = W.load_config(config)
    cfg["dataset"]["benchmark_rolling_window"] = None
    assert {"rolling_benchmark_beta_20d", "rolling_benchmark_correlation_20d"} <= set(W.build_dataset(spark, cfg).columns)


def test_dataset_and_backtest(spark, config):
    panel, signal, daily = W.backtest(spark, W.load_config(config))
    assert signal == "momentum_signal_2d" and panel.count() == 30 and daily.count() == 10
    assert {"rolling_benchmark_beta_3d", "is_universe_eligible", "portfolio_weight"} <= set(panel.columns)
    assert daily.agg(F.max("turnover")).first()[0] <= 0.75 + 1e-12


def test_commands(spark, config, tmp_path, capsys):
    c = ["--config", str(config)]
    assert cli.main(["validate-data", *c]) == 0 and "symbols: 3" in capsys.readouterr().out
    assert cli.main(["build-dataset", *c, "--output", str(tmp_path / "panel")]) == 0
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 30
    assert cli.main(["run-backtest", *c, "--output", str(tmp_path / "daily.csv")]) == 0
    assert len((tmp_path / "daily.csv").read_text().splitlines()) == 11
    assert cli.main(["report", *c, "--artifact-dir", str(tmp_path / "r")]) == 0
    assert "Performance Summary" in (tmp_path / "r/report.txt").read_text() and "<svg" in (tmp_path / "r/index.html").read_text()
    assert len(json.loads((tmp_path / "r/charts/manifest.json").read_text())["charts"]) == 12
    root = str(tmp_path / "runs")
    assert cli.main(["sweep-signal", *c, "--parameter", "lookback", "--values", "1", "2", "--experiment-root", root]) == 0
    assert cli.main(["walk-forward-signal", *c, "--parameter", "lookback", "--values", "1", "2", "--train-periods", "4", "--test-periods", "2", "--experiment-root", root]) == 0
    runs = artifacts.load_run_index(root)
    assert [r["command"] for r in runs] == ["sweep-signal", "walk-forward-signal"] and [r["row_count"] for r in runs] == [2.0, 3.0]
    capsys.readouterr()
    assert cli.main(["list-runs", "--experiment-root", root, "--limit", "1"]) == 0 and len(capsys.readouterr().out.splitlines()) == 1
    assert cli.main(["compare-runs", "--experiment-root", root, "--rank-by", "cumulative_return"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert [r["rank_cumulative_return"] for r in got] == [1, 2]
    walked = next(r for r in got if r["command"] == "walk-forward-signal")
    assert abs(walked["cumulative_return"] - runs[1]["overall_cumulative_return"]) < 1e-12
    assert cli.main(["list-runs", "--experiment-root", str(tmp_path / "none")]) == 1


def test_ranks_and_filters():
    runs = [{"run_id": i, "a": a, "b": b} for i, a, b in ((1, 1.0, None), (2, 2.0, 5.0), (3, 2.0, 9.0))]
    got = {r["run_id"]: r for r in artifacts.rank(runs, {"a": 1, "b": 3})}
    assert [got[i]["rank_a"] for i in (1, 2, 3)] == [3, 1, 1] and [got[i]["rank_b"] for i in (1, 2, 3)] == [3, 2, 1]
    assert got[2]["score"] == 7 / 4
    with pytest.raises(artifacts.ArtifactError):
        artifacts.rank(runs, {"a": 0})


def test_json_csv_and_limits(spark, tmp_path):
    p = artifacts.write_json({"b": float("nan"), "a": (1, 2)}, tmp_path / "x.json")
    assert json.loads(p.read_text()) == {"a": [1, 2], "b": None} and p.read_text().index('"a"') < p.read_text().index('"b"')
    df = spark.createDataFrame([(1, None), (2, "x,y")], "a int, b string")
    assert artifacts.write_dataframe(df, tmp_path / "x.csv").read_text() == 'a,b\n1,\n2,"x,y"\n'
    with pytest.raises(artifacts.ArtifactError):
        artifacts.write_dataframe(df, tmp_path / "y.csv", most=1)
    with pytest.raises(artifacts.ArtifactError):
        artifacts.write_text("x", tmp_path)


def test_feature_cache(spark, config, tmp_path):
    cfg = W.load_config(config)
    df, path = W.build_dataset(spark, cfg), str(tmp_path / "cache")
    manifest = cache.write_cache(df, path, cfg)
    got = cache.load_cache(spark, path, cfg)
    assert manifest["row_count"] == got.count() == 30 and "forward_return_1d" not in got.columns
    assert cache.fingerprint({"a": 1, "b": 2}) == cache.fingerprint({"b": 2, "a": 1})
    with pytest.raises(cache.CacheError):
        cache.load_cache(spark, path, {**cfg, "extra": 1})
    got.limit(3).write.mode("overwrite").parquet(f"{path}2/table")
    spark.read.text(f"{path}/manifest").write.text(f"{path}2/manifest")
    with pytest.raises(cache.CacheError):
        cache.load_cache(spark, f"{path}2")


def test_charts_are_whole():
    svg = reports.line_chart("a < b", [1, 2, 3], {"x": [1.0, None, 2.0], "none": [None] * 3})
    assert "a &lt; b" in svg and svg.count("<path") == 2 and svg.count("M") >= 2
    assert reports.line_chart("empty", [], {}).endswith("</svg>")


def test_provenance_of_columns_and_signals(spark, config):
    cfg = W.load_config(config)
    panel, signal, _ = W.backtest(spark, cfg)
    by = {x["column"]: x for x in P.feature_sources(panel.columns)}
    assert by["forward_return_1d"]["role"] == "label" and by["forward_return_1d"]["parameters"] == {"n": 1}
    assert by["yang_zhang_volatility_3d"]["family"] == "range_volatility" and by["rolling_benchmark_beta_3d"]["inputs"] == ["daily_return", "benchmark_return"]
    assert by["is_universe_eligible"]["role"] == "filter" and by[signal]["role"] == "signal"
    got = {c: P.column_source(c) for c in ("fundamental_net_income", "valuation_eps_to_price", "quality_a_to_b", "growth_a", "trend_signal_2_5d_zscore", "market_cap_bucket", "my_input", "borrow_fee_bps")}
    assert got["valuation_eps_to_price"].inputs == ("fundamental_eps", "close") and got["quality_a_to_b"].inputs == ("fundamental_a", "fundamental_b")
    assert got["trend_signal_2_5d_zscore"].parameters == {"n": 2, "m": 5} and got["my_input"].family == "input" and got["borrow_fee_bps"].source == "borrow_availability"
    cfg["signal"] |= {"winsorize_quantile": 0.1, "cross_sectional_normalization": "zscore"}
    s = P.signal_source(cfg)
    assert s["raw_column"] == "momentum_signal_2d" and [x["transform"] for x in s["steps"]] == ["winsorize", "zscore"] and s["column"] == "momentum_signal_2d_winsorized_zscore"
    a, b = P.plan_identity(panel.columns, cfg), P.plan_identity(panel.columns[:-1], W.load_config(config))
    assert a["cache_key"] != b["cache_key"] and a["labels"] == ["forward_return_1d"] and signal in a["signals"]
    assert a["cache_key"] == P.plan_identity(panel.columns, cfg)["cache_key"]


def test_definitions_are_listed():
    assert [f["name"] for f in X.list_factors()] == ["momentum", "mean_reversion", "trend"] and X.get_factor(" Trend ")["parameters"] == {"short": 20, "long": 60}
    assert {t["name"] for t in T.list_transforms()} == {"winsorize", "clip", "residualize", "demean", "zscore", "robust_zscore", "rank"}
    for f in (X.get_factor, T.get_transform):
        with pytest.raises(ValueError, match="unknown"):
            f("none")


def test_dataset_through_the_feature_cache(spark, config, tmp_path, capsys):
    c = ["build-dataset", "--config", str(config), "--feature-cache", str(tmp_path / "cache")]
    assert cli.main([*c, "--output", str(tmp_path / "a")]) == 0
    made = (tmp_path / "cache/table/_SUCCESS").stat().st_mtime_ns
    assert cli.main([*c, "--output", str(tmp_path / "b")]) == 0
    assert (tmp_path / "cache/table/_SUCCESS").stat().st_mtime_ns == made  # read, not made again
    assert spark.read.parquet(str(tmp_path / "b")).count() == 30
    assert len(cache.load_manifest(spark, str(tmp_path / "cache"))["plan"]["cache_key"]) == 64


def test_comparison_bundle(tmp_path):
    sweep = tmp_path / "s.csv"
    sweep.write_text("parameter_value,cumulative_return,sharpe_ratio,mean_ic,max_drawdown,average_turnover\n1,0.1,1,0.2,-0.1,0.5\n2,0.3,,0.1,0,0.4\n3,,2,0.1,0,0.4\n")
    folds = tmp_path / "w.csv"
    folds.write_text("fold_index,selected_parameter_value,test_cumulative_return,test_mean_ic\n1,2,0.1,0.5\n2,1,-0.1,\n")
    runs = [{"run_id": "a", "command": "sweep-signal", "parameter": "lookback", "values": "1,2,3", "results_path": str(sweep), "cumulative_return": 0.3, "sharpe_ratio": None, "mean_ic": 0.1, "best_value": "2"}]
    runs.append({"run_id": "b", "command": "walk-forward-signal", "parameter": "lookback", "values": "1,2", "results_path": str(folds), "cumulative_return": -0.01, "sharpe_ratio": None, "mean_ic": 0.5})
    text = comparison.report(runs, 2)
    assert "best of lookback" in text and "folds of lookback" in text and text.index("0.3") < text.index("best of lookback")
    assert len([x for x in text.split("\n\n")[1].splitlines()]) == 4  # title, head, two candidates
    comparison.write_comparison(tmp_path / "out", runs)
    got = json.loads((tmp_path / "out/comparison.json").read_text())
    assert got["run_ids"] == ["a", "b"] and got["best"] == {"cumulative_return": "a", "sharpe_ratio": None, "mean_ic": "b"}
    assert (tmp_path / "out/index.html").is_file() and len(list((tmp_path / "out/charts").glob("*.svg"))) == 5
    with pytest.raises(artifacts.ArtifactError):
        comparison.report(runs, 0)

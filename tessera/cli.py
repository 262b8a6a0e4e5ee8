"""The command line: ``python -m tessera.cli COMMAND ...``. Expected errors end with
exit code 1 and one line on stderr."""

from __future__ import annotations

import argparse
import json
import math
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __name__ as NAME
from .plans import experiments as E
from .plans import provenance as P
from .plans import workflow as W
from .sinks import artifacts as A
from .sinks import cache as C
from .sinks import reports as R
from .sinks.comparison import write_comparison

PARAMETERS = {"lookback": "lookback", "short_window": "short", "long_window": "long"}
METRICS = ("cumulative_return", "sharpe_ratio", "mean_ic")


def _session() -> SparkSession:
    return SparkSession.builder.appName(NAME).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=NAME)
    p.add_argument("--version", action="version", version=f"{NAME} 0.1")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, config: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        if config:
            c.add_argument("--config", required=True)
        for o in options:
            c.add_argument(o)
        return c

    command("validate-data")
    command("build-dataset", "--output", "--feature-cache")
    command("run-backtest", "--output")
    command("report", "--artifact-dir")
    command("plot-report").add_argument("--output-dir", required=True)
    for name in ("sweep-signal", "walk-forward-signal"):
        c = command(name, "--output", "--artifact-dir", "--experiment-root")
        c.add_argument("--parameter", required=True, choices=list(PARAMETERS))
        c.add_argument("--values", required=True, nargs="+", type=int)
        if name == "walk-forward-signal":
            c.add_argument("--train-periods", required=True, type=int)
            c.add_argument("--test-periods", required=True, type=int)
            c.add_argument("--selection-metric", default=METRICS[0], choices=METRICS)
    for name in ("list-runs", "compare-runs"):
        c = command(name, "--command-name", "--parameter", config=False)
        c.add_argument("--experiment-root", required=True)
        c.add_argument("--sort-by", default="created_at")
        c.add_argument("--ascending", action="store_true")
        c.add_argument("--limit", type=int)
        if name == "compare-runs":
            c.add_argument("--run-id", action="append", default=[])
            c.add_argument("--rank-by", action="append", default=[], choices=METRICS)
            c.add_argument("--rank-weight", action="append", default=[], type=float)
            c.add_argument("--artifact-dir")
            c.add_argument("--top", type=int, default=3)
    return p


def _emit(df: DataFrame, output: str | None, title: str) -> None:
    """A Parquet folder, a CSV file or the first rows on stdout."""
    if not output:
        print(R.section(title, df.limit(20)))
    elif output.endswith(".csv"):
        A.write_dataframe(df, output)
    else:
        A.write_table(df, output)


def _dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    """The panel; with a feature cache it is read from there if the same settings made it,
    and else made and written there (labels, which look ahead, are never cached)."""
    cfg = W.load_config(a.config)
    if not a.feature_cache:
        _emit(W.build_dataset(spark, cfg), a.output, "Dataset")
        return
    try:
        df = C.load_cache(spark, a.feature_cache, cfg)
    except (C.CacheError, AnalysisException):
        C.write_cache(W.build_dataset(spark, cfg), a.feature_cache, cfg, P.plan_identity)
        df = C.load_cache(spark, a.feature_cache, cfg)
    _emit(df, a.output, "Dataset")


def _experiment(spark: SparkSession, a: argparse.Namespace) -> None:
    cfg = W.load_config(a.config)
    panel = W.build_dataset(spark, cfg).cache()
    name, g = PARAMETERS[a.parameter], cfg["diagnostics"]
    fixed = {k: v for k, v in W.factor_parameters(cfg).items() if k != name}
    common = {
        "settings": W.backtest_settings(cfg), "top_n": cfg.get("portfolio", {}).get("top_n", 1), "label": g["forward_return_column"], "least": g["min_observations"], "method": g["ic_method"],
        "prepare": lambda df, s: W.refine(df, s, cfg), "weights": lambda df, s: W.add_weights(df, s, cfg), **fixed,
    }
    factor, fields = cfg["signal"]["name"], {"command": a.command, "config": a.config, "parameter": a.parameter, "values": ",".join(map(str, a.values))}
    if a.command == "sweep-signal":
        results = E.sweep(panel, factor, name, a.values, construction=cfg.get("portfolio", {}).get("construction", "long_only"), **common).withColumn("parameter_name", F.lit(a.parameter)).orderBy("parameter_value").cache()
        parts = {"Results": results, "Best": E.rank_sweep(results)}
    else:
        results = E.walk_forward(panel, factor, name, a.values, train=a.train_periods, test=a.test_periods, metric=a.selection_metric, **common).withColumn("parameter_name", F.lit(a.parameter)).orderBy("fold_index").cache()
        parts = {"Folds": results}
        fields |= {"selection_metric": a.selection_metric, "train_periods": a.train_periods, "test_periods": a.test_periods}
        returns = [r[0] for r in results.select("test_cumulative_return").collect() if r[0] is not None]  # one a fold
        fields["overall_cumulative_return"] = math.prod(1 + x for x in returns) - 1 if returns else None
    text = R.report_text(a.command, parts)
    fields["row_count"] = results.count()
    if a.output:
        _emit(results, a.output, a.command)
    if a.artifact_dir:
        A.write_bundle(a.artifact_dir, results, text, fields)
    if a.experiment_root:
        fields["run_id"] = A.new_run_id(a.command, a.parameter)
        A.write_indexed_bundle(a.experiment_root, fields.pop("run_id"), results, text, fields, **fields)
    print(text)


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    cfg = W.load_config(a.config)
    panel, signal, daily = W.backtest(spark, cfg)
    panel, daily = panel.cache(), daily.cache()
    title = f"Report: {cfg['signal']['name']}"
    if a.command == "plot-report":
        R.write_charts(a.output_dir, W.charts(panel, signal, daily, cfg))
        return
    text = R.report_text(title, W.summaries(panel, signal, daily, cfg))
    print(text)
    if a.artifact_dir:
        d, pictures = Path(a.artifact_dir), W.charts(panel, signal, daily, cfg)
        A.write_bundle(d, daily.orderBy("date"), text, {"config": cfg, "signal_column": signal, "columns": panel.columns, "features": P.feature_sources(panel.columns), "signal": P.signal_source(cfg), "feature_plan": P.plan_identity(panel.columns, cfg)})
        R.write_charts(d / "charts", pictures)
        A.write_text(R.html_page(title, text, pictures), d / "index.html")


def _runs(a: argparse.Namespace) -> None:
    chosen = A.list_runs(a.experiment_root, a.command_name, a.parameter, a.sort_by, not a.ascending, a.limit)
    if a.command == "list-runs":
        for r in chosen:
            print("\t".join("" if r[k] is None else str(r[k]) for k in ("run_id", "created_at", "command", "parameter", "values", "row_count")))
        return
    runs = A.compare_runs(a.experiment_root, a.run_id or [r["run_id"] for r in chosen])
    if a.rank_by:
        if a.rank_weight and len(a.rank_weight) != len(a.rank_by):
            raise A.ArtifactError("one weight for each metric, or none")
        runs = A.rank(runs, dict(zip(a.rank_by, a.rank_weight or [1.0] * len(a.rank_by), strict=True)))
    text = json.dumps(A.plain([{k: str(v) if isinstance(v, Path) else v for k, v in r.items()} for r in runs]), indent=2)
    print(text)
    if a.artifact_dir:
        write_comparison(a.artifact_dir, runs, a.top)


def run(a: argparse.Namespace) -> None:
    if a.command in ("list-runs", "compare-runs"):
        _runs(a)
        return
    spark = _session()
    if a.command == "validate-data":
        print(W.validation_text(spark, W.load_config(a.config)))
    elif a.command == "build-dataset":
        _dataset(spark, a)
    elif a.command == "run-backtest":
        _emit(W.backtest(spark, W.load_config(a.config))[2].orderBy("date"), a.output, "Backtest")
    elif a.command in ("report", "plot-report"):
        _report(spark, a)
    else:
        _experiment(spark, a)


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except (ValueError, AnalysisException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

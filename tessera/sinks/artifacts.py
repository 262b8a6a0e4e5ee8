"""Result files of a run and the index of runs.

Bundles hold results of bounded size (rows per date, candidate or fold). A frame is
fetched by the driver only up to ``MAX_ROWS``; beyond it writing raises, and the table
belongs in Parquet (:func:`write_table`), which executors write in parallel.
"""

from __future__ import annotations

import csv
import datetime as dt
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

MAX_ROWS = 1_000_000
#: The columns of the run index.
INDEX = (
    "run_id", "created_at", "command", "config", "parameter", "values", "selection_metric", "train_periods", "test_periods",
    "row_count", "overall_cumulative_return", "artifact_dir", "results_path", "report_path", "metadata_path",
)
NUMBERS = ("train_periods", "test_periods", "row_count", "overall_cumulative_return")


class ArtifactError(ValueError):
    """A file of a run is missing, malformed or in the way."""


def _target(path: str | Path) -> Path:
    p = Path(path)
    if p.is_dir():
        raise ArtifactError(f"a file is wanted, {p} is a folder")
    p.parent.mkdir(parents=True, exist_ok=True)
    return p


def fetch(df: DataFrame, most: int = MAX_ROWS) -> list:
    """The rows of a small result; an error, never a cut, if there are more."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ArtifactError(f"over {most} rows; write a Parquet table instead")
    return rows


def write_dataframe(df: DataFrame, path: str | Path, most: int = MAX_ROWS) -> Path:
    """A CSV file with a header; missing values are empty fields."""
    rows, p = fetch(df, most), _target(path)
    with p.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(["" if v is None else v for v in r] for r in rows)
    return p


def write_table(df: DataFrame, path: str) -> str:
    """A Parquet folder of any size, through Spark's own file systems."""
    df.write.mode("errorifexists").parquet(path)
    return path


def write_text(text: str, path: str | Path) -> Path:
    p = _target(path)
    p.write_text(text if text.endswith("\n") else text + "\n", encoding="utf-8")
    return p


def plain(x: Any) -> Any:
    """JSON values: dates as ISO text, NaN and infinities as null, tuples as lists."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else x


def write_json(value: Any, path: str | Path) -> Path:
    return write_text(json.dumps(plain(value), indent=2, sort_keys=True, ensure_ascii=False), path)


def write_bundle(folder: str | Path, results: DataFrame, report: str, metadata: dict) -> dict[str, Path]:
    """results.csv, report.txt and metadata.json."""
    d = Path(folder)
    return {"results_path": write_dataframe(results, d / "results.csv"), "report_path": write_text(report, d / "report.txt"), "metadata_path": write_json(metadata, d / "metadata.json")}


def new_run_id(command: str, parameter: str | None = None, now: dt.datetime | None = None) -> str:
    now = now or dt.datetime.now(dt.UTC)
    return "-".join([now.strftime("%Y%m%dT%H%M%S%fZ"), command, *([parameter] if parameter else [])])


def write_indexed_bundle(root: str | Path, run_id: str, results: DataFrame, report: str, metadata: dict, **fields: Any) -> dict:
    """A bundle under root/run_id and its row at the end of root/runs.csv."""
    root = Path(root)
    if any(r["run_id"] == run_id for r in (load_run_index(root) if (root / "runs.csv").exists() else [])):
        raise ArtifactError(f"run {run_id} is in the index already")
    if set(fields) - set(INDEX):
        raise ArtifactError(f"not columns of the index: {sorted(set(fields) - set(INDEX))}")
    paths = write_bundle(root / run_id, results, report, metadata)
    row = {"run_id": run_id, "created_at": dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), **fields, "artifact_dir": root / run_id, **paths}
    new = not (root / "runs.csv").exists()
    with (root / "runs.csv").open("a", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, INDEX, lineterminator="\n")
        if new:
            out.writeheader()
        out.writerow({k: "" if v is None else v for k, v in row.items()})
    return row


def load_run_index(root: str | Path) -> list[dict]:
    """The runs in file order; numbers as floats, empty fields as None."""
    p = Path(root) / "runs.csv"
    if not p.is_file():
        raise ArtifactError(f"no run index at {p}")
    with p.open(newline="", encoding="utf-8") as f:
        read = csv.DictReader(f)
        if missing := [c for c in INDEX if c not in (read.fieldnames or [])]:
            raise ArtifactError(f"{p}: missing columns {missing}")
        rows = [{k: v or None for k, v in r.items() if k} for r in read]
    for r in rows:
        for k in NUMBERS:
            try:
                r[k] = None if r[k] is None else float(r[k])
            except ValueError:
                raise ArtifactError(f"{p}: {k} of {r['run_id']} is not a number: {r[k]}") from None
    ids = [r["run_id"] for r in rows]
    if None in ids or len(set(ids)) < len(ids):
        raise ArtifactError(f"{p}: run_id is missing or repeated")
    return rows


def list_runs(root: str | Path, command: str | None = None, parameter: str | None = None, sort_by: str = "created_at", descending: bool = True, limit: int | None = None) -> list[dict]:
    """Runs that pass the filters, sorted, those without a value last; then the first ``limit``."""
    if sort_by not in INDEX or (limit is not None and limit < 1):
        raise ArtifactError("sort_by is a column of the index, limit 1 or more")
    rows = [r for r in load_run_index(root) if command in (None, r["command"]) and parameter in (None, r["parameter"])]
    have = sorted((r for r in rows if r[sort_by] is not None), key=lambda r: r[sort_by], reverse=descending)
    return (have + [r for r in rows if r[sort_by] is None])[:limit]


def run_summary(run: dict) -> dict:
    """A run with the figures of its results: a sweep's best value by cumulative return,
    or a walk-forward's return over all folds and mean test IC."""
    p = Path(run["results_path"])
    if not p.is_file():
        raise ArtifactError(f"{run['run_id']}: no results at {p}")
    with p.open(newline="", encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    num = lambda r, k: float(r[k]) if r.get(k) else None
    if run["command"] == "walk-forward-signal":
        ics = [x for r in rows if (x := num(r, "test_mean_ic")) is not None]
        returns = [x for r in rows if (x := num(r, "test_cumulative_return")) is not None]
        return run | {"cumulative_return": math.prod(1 + x for x in returns) - 1 if returns else None, "sharpe_ratio": None, "mean_ic": sum(ics) / len(ics) if ics else None}
    best = max((r for r in rows if num(r, "cumulative_return") is not None), key=lambda r: num(r, "cumulative_return"), default={})
    return run | {"best_value": best.get("parameter_value"), **{k: num(best, k) for k in ("cumulative_return", "sharpe_ratio", "mean_ic")}}


def compare_runs(root: str | Path, run_ids: list[str]) -> list[dict]:
    """The summaries in the order asked for."""
    by = {r["run_id"]: r for r in load_run_index(root)}
    if missing := [i for i in run_ids if i not in by]:
        raise ArtifactError(f"not in the index: {missing}")
    return [run_summary(by[i]) for i in run_ids]


def rank(runs: list[dict], by: dict[str, float]) -> list[dict]:
    """Runs by the weighted mean of their ranks: a rank is one more than the number of
    better runs, and runs without the figure share the last."""
    if not by or any(w <= 0 for w in by.values()):
        raise ArtifactError("metrics with positive weights are needed")
    out = []
    for r in runs:
        ranks = {}
        for m in by:
            have = [x[m] for x in runs if x.get(m) is not None]
            ranks[f"rank_{m}"] = 1 + (len(have) if r.get(m) is None else sum(v > r[m] for v in have))
        out.append(r | ranks | {"score": sum(ranks[f"rank_{m}"] * w for m, w in by.items()) / sum(by.values())})
    return sorted(out, key=lambda r: r["score"])

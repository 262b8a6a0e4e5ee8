"""Comparison of indexed runs: one table of all, then each run's best candidates or folds,
and charts of their figures. Runs and their results are small files of the driver."""

from __future__ import annotations

import csv
from pathlib import Path

from . import artifacts as A
from . import reports as R

#: Columns of the first table; ranks and the score follow where runs were ranked.
SUMMARY = ("run_id", "command", "parameter", "values", "best_value", "cumulative_return", "sharpe_ratio", "mean_ic")
SWEEP = ("parameter_value", "cumulative_return", "sharpe_ratio", "mean_ic", "max_drawdown", "average_turnover")
FOLDS = ("fold_index", "selected_parameter_value", "train_start", "train_end", "test_start", "test_end", "train_selection_score", "test_cumulative_return", "test_mean_ic")


def _results(run: dict) -> list[dict]:
    with Path(run["results_path"]).open(newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def _number(x: str | None) -> float | None:
    return float(x) if x else None


def _grid(title: str, columns: tuple, rows: list[dict]) -> str:
    def cell(v) -> str:
        try:
            return "-" if v in (None, "") else f"{float(v):.6g}"
        except ValueError:
            return str(v)

    grid = [list(columns), *[[cell(r.get(c)) for c in columns] for r in rows]]
    width = [max(len(r[i]) for r in grid) for i in range(len(columns))]
    return "\n".join([title, *["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in grid]])


def report(runs: list[dict], top: int = 3) -> str:
    """The runs side by side, then the best ``top`` candidates of each sweep and all
    folds of each walk-forward run."""
    if top < 1:
        raise A.ArtifactError("at least one candidate is shown")
    ranks = tuple(k for k in (runs[0] if runs else {}) if k.startswith("rank_") or k == "score")
    parts = [_grid("Compared Runs", (*SUMMARY, *ranks), runs)]
    for r in runs:
        rows = _results(r)
        if r["command"] == "walk-forward-signal":
            parts.append(_grid(f"{r['run_id']}: folds of {r['parameter']}", FOLDS, rows))
        else:
            order = sorted(rows, key=lambda x: -(_number(x.get("cumulative_return")) if x.get("cumulative_return") else float("-inf")))
            parts.append(_grid(f"{r['run_id']}: best of {r['parameter']}", SWEEP, order[:top]))
    return "\n\n".join(parts) + "\n"


def charts(runs: list[dict]) -> dict[str, str]:
    """The runs' figures side by side, and each run's over its candidates or folds."""
    names = [r["run_id"] for r in runs]
    out = {f"compared_{m}": R.line_chart(f"{m} by run", names, {m: [r.get(m) for r in runs]}) for m in ("cumulative_return", "sharpe_ratio", "mean_ic")}
    for r in runs:
        rows, folds = _results(r), r["command"] == "walk-forward-signal"
        x, ys = ("fold_index", ("test_cumulative_return", "test_mean_ic")) if folds else ("parameter_value", ("cumulative_return", "mean_ic"))
        out[f"run_{r['run_id']}"] = R.line_chart(f"{r['run_id']} by {x}", [row[x] for row in rows], {y: [_number(row.get(y)) for row in rows] for y in ys})
    return out


def write_comparison(folder: str | Path, runs: list[dict], top: int = 3) -> None:
    """comparison.json, report.txt, the charts and a page of both."""
    folder, text, pictures = Path(folder), report(runs, top), charts(runs)
    A.write_json({"runs": runs, "run_ids": [r["run_id"] for r in runs], "best": {m: max((r for r in runs if r.get(m) is not None), key=lambda r: r[m], default={}).get("run_id") for m in ("cumulative_return", "sharpe_ratio", "mean_ic")}}, folder / "comparison.json")
    A.write_text(text, folder / "report.txt")
    R.write_charts(folder / "charts", pictures)
    A.write_text(R.html_page("Compared Runs", text, pictures), folder / "index.html")

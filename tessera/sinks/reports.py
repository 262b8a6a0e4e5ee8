"""Reports as text and HTML, and charts as SVG. Inputs are summaries: rows a date at most."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame

from .artifacts import fetch, write_json, write_text


def number(x: object) -> str:
    return "-" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)


def section(title: str, df: DataFrame, most: int = 10_000) -> str:
    """A title and the rows: one row as name and value lines, more as aligned columns."""
    rows = [[number(v) for v in r] for r in fetch(df, most)]
    if len(rows) == 1:
        lines = [f"{c}: {v}" for c, v in zip(df.columns, rows[0], strict=True)]
    else:
        grid = [df.columns, *rows]
        width = [max(len(r[i]) for r in grid) for i in range(len(df.columns))]
        lines = ["  ".join(v.rjust(w) for v, w in zip(r, width, strict=True)) for r in grid]
    return "\n".join([title, *lines])


def report_text(title: str, parts: dict[str, DataFrame]) -> str:
    return "\n\n".join([title, *[section(k, v) for k, v in parts.items()]]) + "\n"


def line_chart(title: str, x: list, series: dict[str, list], width: int = 720, height: int = 280) -> str:
    """An SVG of one line a series; missing values break the line."""
    colours = ("#1b6ca8", "#c8553d", "#3f8f5b", "#7d5ba6", "#8a6d3b")
    seen = [v for s in series.values() for v in s if v is not None]
    low, high = (min(seen), max(seen)) if seen else (0.0, 1.0)
    span, step = (high - low) or 1.0, (width - 90) / max(1, len(x) - 1)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img"><title>{html.escape(title)}</title>', f'<text x="10" y="18" font-size="14">{html.escape(title)}</text>']
    out += [f'<text x="4" y="{y}" font-size="10">{v:.4g}</text>' for v, y in ((high, 40), (low, height - 30))]
    for i, (name, values) in enumerate(series.items()):
        colour, path, pen = colours[i % len(colours)], [], "M"
        for k, v in enumerate(values):
            if v is None:
                pen = "M"
                continue
            path.append(f"{pen}{70 + k * step:.1f},{height - 34 - (v - low) / span * (height - 74):.1f}")
            pen = "L"
        out.append(f'<path d="{" ".join(path)}" fill="none" stroke="{colour}" stroke-width="1.5"/>')
        out.append(f'<text x="{70 + i * 150}" y="{height - 6}" font-size="11" fill="{colour}">{html.escape(name)}</text>')
    if x:
        out.append(f'<text x="{width - 110}" y="18" font-size="10">{html.escape(f"{x[0]} .. {x[-1]}")}</text>')
    return "".join([*out, "</svg>"])


def chart(title: str, df: DataFrame, x: str, columns: list[str], by: str | None = None) -> str:
    """The columns over x in order; with ``by``, one line a group of the first column."""
    rows = fetch(df.select(x, *([by] if by else []), *columns).orderBy(x), 200_000)
    if not by:
        return line_chart(title, [r[0] for r in rows], {c: [r[c] for r in rows] for c in columns})
    at = sorted({r[0] for r in rows})
    place = {v: i for i, v in enumerate(at)}
    lines: dict = {}
    for r in rows:
        lines.setdefault(str(r[by]), [None] * len(at))[place[r[0]]] = r[columns[0]]
    return line_chart(title, at, dict(sorted(lines.items())))


def write_charts(folder: str | Path, charts: dict[str, str]) -> dict[str, Path]:
    """One SVG a chart and manifest.json."""
    paths = {name: write_text(svg, Path(folder) / f"{name}.svg") for name, svg in charts.items()}
    write_json({"charts": [{"name": n, "file": p.name} for n, p in paths.items()]}, Path(folder) / "manifest.json")
    return paths


def html_page(title: str, text: str, charts: dict[str, str]) -> str:
    """A page with nothing outside itself: the charts, then the report."""
    body = "".join(f"<figure>{svg}</figure>" for svg in charts.values())
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>body{{font:14px sans-serif;max-width:60em;margin:2em auto}}figure{{margin:1em 0}}</style></head><body><h1>{html.escape(title)}</h1>{body}<pre>{html.escape(text)}</pre></body></html>'

"""Presentation of small result tables: Markdown, SVG, file bundles. Rows come to the driver; the tables are results, not data."""

from __future__ import annotations

import shutil
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame


def markdown_table(df: DataFrame, rows: int | None = None) -> str:
    got = (df.limit(rows) if rows else df).collect()
    if not got:
        return "No rows."
    show = lambda x: "" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(map(show, r))} |" for r in got])


def ramp(value: float, low: float, high: float) -> str:
    """Colour between blue and red; the middle where all values are equal."""
    t = 0.5 if high <= low else (value - low) / (high - low)
    return f"rgb({round(40 + 200 * t)},{round(90 - 30 * t)},{round(220 - 180 * t)})"


def heatmap_svg(cells: DataFrame, metric: str, row: str = "lambda", col: str = "beta", title: str = "") -> str:
    """Grid of a metric; a missing cell counts 0."""
    got = {(r[row], r[col]): r[metric] for r in cells.select(row, col, metric).collect()}
    ys, xs = sorted({k[0] for k in got}), sorted({k[1] for k in got})
    known = [v for v in got.values() if v is not None] or [0.0]
    low, high, side = min(known), max(known), 60
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{80 + side * len(xs)}" height="{60 + side * len(ys)}"><text x="8" y="20">{escape(title or metric)}</text>']
    for i, y in enumerate(ys):
        out.append(f'<text x="8" y="{40 + side * i + side // 2}">{y:g}</text>')
        for j, x in enumerate(xs):
            v = got.get((y, x)) or 0.0
            out.append(f'<rect x="{70 + side * j}" y="{40 + side * i}" width="{side}" height="{side}" fill="{ramp(v, low, high)}"/><text x="{76 + side * j}" y="{40 + side * i + side // 2}" font-size="11">{v:.3f}</text>')
    out += [f'<text x="{76 + side * j}" y="36" font-size="11">{x:g}</text>' for j, x in enumerate(xs)]
    return "\n".join([*out, "</svg>"])


def bars_svg(pivot: DataFrame, title: str = "", key: str = "dataset") -> str:
    """Grouped bars of a dataset x method table, scaled to its greatest value."""
    rows, names = pivot.orderBy(key).collect(), [c for c in pivot.columns if c != key]
    top = max([r[n] or 0.0 for r in rows for n in names], default=0.0) or 1.0
    width, out, x = 24, [], 40
    for r in rows:
        out.append(f'<text x="{x}" y="235" font-size="12">{escape(str(r[key]))}</text>')
        for i, n in enumerate(names):
            h = 180 * (r[n] or 0.0) / top
            out.append(f'<rect x="{x}" y="{215 - h:.1f}" width="{width - 4}" height="{h:.1f}" fill="{ramp(i, 0, max(1, len(names) - 1))}"><title>{escape(n)}: {r[n] or 0.0:.4f}</title></rect>')
            x += width
        x += width
    return "\n".join([f'<svg xmlns="http://www.w3.org/2000/svg" width="{x + 20}" height="250"><text x="8" y="18">{escape(title)}</text>', *out, "</svg>"])


def bundle(root: str, names: list[str], out: str) -> list[str]:
    """Copies the files that exist; parts of their paths are joined by ``__``, so that equal names do not collide."""
    Path(out).mkdir(parents=True, exist_ok=True)
    done = []
    for n in names:
        if (Path(root) / n).is_file():
            to = "__".join(Path(n).parts)
            shutil.copyfile(Path(root) / n, Path(out) / to)
            done.append(to)
    return done


def summary(out: str, tables: dict[str, DataFrame], rows: int = 10) -> str:
    text = "\n\n".join([f"## {name}\n\n{markdown_table(df, rows)}" for name, df in tables.items()])
    Path(out).write_text(text + "\n")
    return text

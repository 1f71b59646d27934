"""What people read: JSON that is the same from run to run, Markdown tables, a page with its data inside, bars. Small results only."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame

#: Where a page's data goes in its template.
SLOT = "/*DATA*/"


def records(df: DataFrame, most: int = 100_000) -> list[dict[str, Any]]:
    """The rows of a small result as dictionaries; more than ``most`` is an error, not a long wait."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    return [r.asDict(recursive=True) for r in rows]


def _rounded(x: Any) -> Any:
    if isinstance(x, float):
        return round(x, 10)
    if isinstance(x, dict):
        return {str(k): _rounded(v) for k, v in x.items()}
    return [_rounded(v) for v in x] if isinstance(x, (list, tuple)) else x


def stable_json(x: Any) -> str:
    """JSON with floats of ten places, as the last digits of a mean differ from run to run."""
    return json.dumps(_rounded(x), indent=2, default=str) + "\n"


def markdown(rows: Iterable[dict[str, Any]], columns: list[str]) -> str:
    """A Markdown table; floats have four places, and a bar in a text does not end its cell."""
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *([cell(r.get(c)) for c in columns] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def script_safe(x: Any) -> str:
    """JSON that may stand inside a script element: nothing in it ends the element or a line of code."""
    out = json.dumps(x, ensure_ascii=False, separators=(",", ":"), default=str)
    for c in "<\u2028\u2029":
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def page(template: str, data: Any) -> str:
    if template.count(SLOT) != 1:
        raise ValueError(f"the template needs {SLOT} once")
    return template.replace(SLOT, script_safe(data))


def matching(rows: list[dict[str, Any]], query: str, columns: list[str]) -> list[dict[str, Any]]:
    """What a page's search box shows: rows in which every word of the query is in one of the columns, in any case."""
    words = query.casefold().split()
    return [r for r in rows if all(any(w in str(r.get(c, "")).casefold() for c in columns) for w in words)]


def bars(values: list[tuple[str, float]], title: str, width: int = 480) -> str:
    """Horizontal bars as SVG, each with its name and value."""
    top = max((abs(v) for _, v in values), default=0.0) or 1.0
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 240}" height="{24 * len(values) + 40}" font-family="sans-serif" font-size="12">', f'<text x="8" y="20" font-size="14">{html.escape(title)}</text>']
    for k, (name, v) in enumerate(values):
        y, w = 36 + 24 * k, abs(v) / top * (width - 80)
        out.append(f'<text x="8" y="{y + 12}">{html.escape(name)}</text><rect x="200" y="{y}" width="{w:.1f}" height="16" fill="#4878a8"/><text x="{206 + w:.1f}" y="{y + 12}">{v:.4f}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"

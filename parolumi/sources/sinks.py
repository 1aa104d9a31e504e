"""Writers of results: documents, partitioned JSON, Markdown, charts, incremental tables."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame, functions as F

#: Documents and reports are made on the driver of at most so many rows.
REPORT_ROWS = 1000


def _few(df: DataFrame) -> list[dict]:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows")
    return [r.asDict(True) for r in rows]


def document(df: DataFrame, path: str) -> None:
    """A small result as an indented JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(_few(df), f, ensure_ascii=False, indent=2, default=str)


def json_per_key(df: DataFrame, path: str, *keys: str) -> None:
    """JSON files in one folder per key value."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).json(path)


def markdown(df: DataFrame, title: str = "") -> str:
    """A Markdown table; numbers as they are, nulls as '-'."""
    rows = _few(df)
    head = f"## {title}\n\n" if title else ""
    if not rows:
        return head + "(no rows)\n"
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return head + "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def bar_chart(df: DataFrame, label: str, value: str, low: str | None = None, high: str | None = None, width: int = 480, bar: int = 18) -> str:
    """A bar chart as SVG, with whiskers between ``low`` and ``high``; nulls have no bar."""
    rows = _few(df)
    top = max([r[high or value] or 0 for r in rows] + [1e-9])
    x = lambda v: 140 + (width - 160) * v / top
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{(bar + 6) * len(rows) + 10}">']
    for i, r in enumerate(rows):
        y = 5 + i * (bar + 6)
        parts.append(f'<text x="4" y="{y + bar - 5}" font-size="11">{escape(str(r[label]))}</text>')
        if r[value] is None:
            continue
        parts.append(f'<rect x="140" y="{y}" width="{x(r[value]) - 140:.1f}" height="{bar}" fill="#4477aa"/>')
        if low and high and r[low] is not None and r[high] is not None:
            parts.append(f'<line x1="{x(r[low]):.1f}" x2="{x(r[high]):.1f}" y1="{y + bar / 2}" y2="{y + bar / 2}" stroke="#222"/>')
    return "\n".join(parts + ["</svg>"])


def missing_only(new: DataFrame, done: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Rows whose key has no non-empty text yet: what an incremental run still has to do."""
    return new.join(done.where(F.coalesce(F.col(text), F.lit("")) != "").select(*key), key, "left_anti")


def append_cache(fresh: DataFrame, path: str) -> None:
    """New memo rows, appended; nothing that is there is written again."""
    fresh.write.mode("append").partitionBy("task").parquet(path)

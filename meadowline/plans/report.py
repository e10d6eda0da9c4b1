"""Markdown reports from small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def table(df: DataFrame, order: Sequence[str] = (), limit: int = 200) -> str:
    """A small table as Markdown; at most ``limit`` rows, as reports show."""
    rows = (df.orderBy(*order) if order else df).limit(limit).collect()
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def report(title: str, sections: dict[str, str | DataFrame]) -> str:
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts.append(f"## {name}\n\n{body if isinstance(body, str) else table(body)}")
    return "\n\n".join(parts) + "\n"

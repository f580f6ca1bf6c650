"""Small result tables as JSON and Markdown. The tables are metrics: a row for each metric or group."""

from __future__ import annotations

import html
import json
import textwrap
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a metric table; more than `most` are an error, not cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a metric table")
    return rows


def _put(df: DataFrame, path: str, text: str) -> None:
    """Write a text beside its place and rename it, in any file system that Spark knows."""
    spark = df.sparkSession
    at, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"cannot rename to {path}")


def write_metrics(df: DataFrame, path: str) -> None:
    _put(df, path, json.dumps(rows_of(df), ensure_ascii=False, default=str))


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A Markdown table; columns without any value are left out, null cells are a dash."""
    rows = rows_of(df)
    names = [c for c in df.columns if any(r[c] is not None for r in rows)]
    cell = lambda x: "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)
    lines = [names, ["---"] * len(names), *[[cell(r[c]) for c in names] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def write_markdown(df: DataFrame, path: str, title: str) -> None:
    _put(df, path, f"# {title}\n\n{markdown(df)}\n")


def write_family_metrics(items: DataFrame, scores: DataFrame, path: str, families: Mapping[str, tuple[str, str]]) -> list[str]:
    """A JSON file for each family with its headline, its scores and its items; families: file name to (family, headline).

    scores has rows (metric, name, value); the headline is a name of metric 'headline'.
    """
    table = rows_of(scores)
    head = {r["name"]: r["value"] for r in table if r["metric"] == "headline"}
    written = []
    for name, (family, key) in families.items():
        own = rows_of(items.where(F.col("family") == family).orderBy("uid"), 100_000)
        content = {"family": family, "metric_key": key, "headline": head.get(key), "summary": [r for r in table if r["metric"] != "headline"], "items": own}
        _put(items, f"{path}/{name}.json", json.dumps(content, ensure_ascii=False, default=str))
        written.append(f"{path}/{name}.json")
    return written


def report(title: str, sections: Mapping[str, DataFrame | None], digits: int = 4) -> str:
    """Markdown with a section for each table that is there and has rows."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        if df is not None and not df.isEmpty():
            parts.append(f"## {name}\n\n{markdown(df, digits)}")
    return "\n\n".join(parts) + "\n"


def wrap(text: str, width: int = 88) -> str:
    """A text's lines broken at a width, its own line ends kept."""
    return "\n".join(line for part in (text or "").split("\n") for line in (textwrap.wrap(part, width) or [""]))


def html_page(title: str, items: DataFrame, fields: Mapping[str, str], mark: str | None = None, most: int = 2000) -> str:
    """Items as a review page: a section an item with its fields under their labels; mark names a boolean column that colours it."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><style>.ok{{background:#efe}}.no{{background:#fee}}pre{{white-space:pre-wrap}}</style><h1>{html.escape(title)}</h1>"]
    for r in rows_of(items, most):
        kind = "" if mark is None or r[mark] is None else " class='ok'" if r[mark] else " class='no'"
        cells = "".join(f"<dt>{html.escape(label)}</dt><dd><pre>{html.escape(wrap(str(r[c])))}</pre></dd>" for c, label in fields.items() if r[c] is not None)
        out.append(f"<section{kind}><dl>{cells}</dl></section>")
    return "\n".join(out)


def write_html(items: DataFrame, path: str, title: str, fields: Mapping[str, str], mark: str | None = None) -> None:
    _put(items, path, html_page(title, items, fields, mark))

"""Sinks. Large frames go through Spark's writers and their commit protocol; one-row documents and reports are driver text."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, keys: list[str], single_file: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines sorted by key: over range partitions, file after file, or in one file if small."""
    df.orderBy(*keys).coalesce(1).write.mode(mode).json(path) if single_file else df.orderBy(*keys).write.mode(mode).json(path)


def document(df: DataFrame) -> dict:
    """The one row of a metrics frame as a nested dict."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a metrics document is one row")
    return rows[0].asDict(recursive=True)


def write_document(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One pretty JSON document, through Spark's text writer, so that any store does and a reader never sees half of it."""
    text = json.dumps(document(df), indent=2, sort_keys=True, ensure_ascii=False, default=str)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """A header and the named fields; missing values are empty."""
    have = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    df.select(*have).coalesce(1).write.mode(mode).csv(path, header=True, emptyValue="", nullValue="")


def append_jsonl(df: DataFrame, path: str) -> None:
    """A checkpoint log: each call's rows appear at once, as new files."""
    df.write.mode("append").json(path)


def write_split(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> None:
    """One folder for each value, in one pass."""
    df.write.mode(mode).partitionBy(by).json(path)


def write_views(df: DataFrame, paths: dict[str, tuple[str, str]], mode: str = "errorifexists") -> None:
    """Several filtered copies (name: (path, condition)) of a frame that is computed once."""
    df.persist()
    try:
        for path, condition in paths.values():
            df.where(condition).write.mode(mode).json(path)
    finally:
        df.unpersist()


def distinct_paths(*paths: str) -> None:
    if len({p.rstrip("/") for p in paths}) != len(paths):
        raise ValueError("inputs and outputs share a path")


def heat_color(value: float | None, most: float) -> str:
    """White at 0, green above, red below, by the share of the largest absolute value."""
    if value is None or not most:
        return "#ffffff"
    fade = round(255 * (1 - min(abs(value) / most, 1)))
    return f"#{fade:02x}ff{fade:02x}" if value > 0 else f"#ff{fade:02x}{fade:02x}"


def heat_table(summary: DataFrame, rows: str | list[str], columns: str, value: str) -> DataFrame:
    """Rows (of one or more keys) by columns; the columns are the few values of a frozen domain."""
    return summary.groupBy(rows).pivot(columns).agg(F.first(value)).orderBy(rows)


def heat_html(wide: DataFrame, rows: str, title: str) -> str:
    """A page of a heat table, which has a row for each method."""
    names = [c for c in wide.columns if c != rows]
    got = wide.collect()
    most = max((abs(r[n]) for r in got for n in names if r[n] is not None), default=0.0)
    cell = lambda v: f'<td style="background:{heat_color(v, most)}">{"" if v is None else f"{v:.4f}"}</td>'
    body = "".join(f"<tr><th>{html.escape(str(r[rows]))}</th>{''.join(cell(r[n]) for n in names)}</tr>" for r in got)
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th></th>{head}</tr>{body}</table></body></html>"


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table of at most `most` rows; a longer frame is an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[shown(v) for v in r] for r in rows]]
    return "".join("| " + " | ".join(x) + " |\n" for x in lines)

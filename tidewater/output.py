"""Rows as an ASCII table, JSON or CSV."""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import json
import math
import os
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row

FORMATS = ("table", "json", "csv")


def _plain(x):
    """A value that JSON can hold: floats beyond numbers by name, the rest as text."""
    if isinstance(x, float) and not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, decimal.Decimal):
        return str(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    return x


def _text(x) -> str:
    x = _plain(x)
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list, bool)) else str(x)


def to_json(names: list[str], rows: Iterable[Row]) -> Iterator[str]:
    """An array of objects, every key in each, in pieces."""
    yield "["
    for k, row in enumerate(rows):
        yield ("," if k else "") + json.dumps(dict(zip(names, map(_plain, row), strict=True)), ensure_ascii=False, separators=(",", ":"))
    yield "]\n"


def to_csv(names: list[str], rows: Iterable[Row]) -> Iterator[str]:
    """RFC 4180 with a header, in pieces."""
    line = io.StringIO()
    out = csv.writer(line, lineterminator="\r\n")
    for row in [names], rows:
        for r in row:
            out.writerow([_text(x) for x in r])
            yield line.getvalue()
            line.seek(0)
            line.truncate()


def to_table(names: list[str], rows: Iterable[Row]) -> Iterator[str]:
    cells = [[_text(x) for x in r] for r in rows]
    width = [max(map(len, column)) for column in zip(names, *cells, strict=True)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+\n"
    line = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, width, strict=True)) + "|\n"
    yield rule + line(names) + rule
    yield from map(line, cells)
    yield rule


def render(df: DataFrame, format: str = "table") -> Iterator[str]:
    """The rows in a format, partition after partition; a table is laid out as a whole."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}; one of {', '.join(FORMATS)}")
    return {"json": to_json, "csv": to_csv, "table": to_table}[format](df.columns, df.toLocalIterator())


def print_rows(df: DataFrame, format: str = "table", out=None) -> None:
    out = out or sys.stdout
    try:
        for piece in render(df, format):
            out.write(piece)
        out.flush()
    except BrokenPipeError:
        # what is left in the buffer has no reader either
        os.dup2(os.open(os.devnull, os.O_WRONLY), out.fileno())

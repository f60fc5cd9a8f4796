"""Writers. A destination of None gives the text itself; a path or an open file gets rows as they stream to the driver; folders are written by the tasks."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row


def _out(dest: Any, encoding: str) -> tuple[Any, bool]:
    if dest is None:
        return io.StringIO(newline=""), False
    if isinstance(dest, (str, Path)):
        return Path(dest).open("w", encoding=encoding, newline=""), True
    return dest, False


def rows_of(df: DataFrame) -> Iterator[Row]:
    return df.toLocalIterator(prefetchPartitions=True)


def delimited(df: DataFrame, dest: Any, encoding: str, delimiter: str, **options: Any) -> str | None:
    out, own = _out(dest, encoding)
    writer = csv.writer(out, delimiter=delimiter, **{"lineterminator": "\n", **options})
    writer.writerow(df.columns)
    for row in rows_of(df):
        writer.writerow(["" if v is None else v for v in row])
    if own:
        out.close()
    return out.getvalue() if dest is None else None


def encoder_of(encoders: Any) -> type[json.JSONEncoder] | None:
    """One class, or one that tries each of several in turn."""
    if encoders is None or isinstance(encoders, type):
        return encoders
    return type("Combined", tuple(encoders), {})


def json_text(df: DataFrame, dest: Any, encoding: str, lines: bool, encoder: Any) -> str | None:
    out, own = _out(dest, encoding)
    cls = encoder_of(encoder)
    tight = {"separators": (",", ":")} if lines else {}
    first = True
    if not lines:
        out.write("[\n")
    for row in rows_of(df):
        text = json.dumps(row.asDict(recursive=True), cls=cls, **tight)
        out.write(text + "\n" if lines else ("" if first else ",\n") + text)
        first = False
    if not lines:
        out.write("\n]\n" if not first else "]\n")
    if own:
        out.close()
    return out.getvalue() if dest is None else None


def excel(df: DataFrame, dest: Any) -> None:
    try:
        import openpyxl
    except ImportError:
        raise RuntimeError("writing spreadsheets needs openpyxl") from None
    book = openpyxl.Workbook(write_only=True)
    sheet = book.create_sheet()
    sheet.append(df.columns)
    for row in rows_of(df):
        sheet.append(list(row))
    book.save(dest)


def folder(df: DataFrame, path: str, kind: str, **options: Any) -> None:
    """Written in parallel, one file a task: parquet, csv, tsv, json."""
    writer = df.write.options(**options)
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.format(kind).save(path)


__all__: Iterable[str] = ["delimited", "encoder_of", "excel", "folder", "json_text", "rows_of"]

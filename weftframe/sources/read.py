"""Readers of delimited, JSON, fixed-width and spreadsheet data. Files that Spark can split are scanned by Spark; others are read on the driver."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PathNotFoundError
from ..functions.convert import Converter
from ..functions.predicates import value_test
from ..operators.record import fitted, kind_over
from ..plans.order import PART, POS
from .fetch import URL_OPTIONS, fetch_url, kind_of, lines_of, read_text, splittable


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)) and not hasattr(value, "_fields"):
        return [_plain(v) for v in value]
    return value


def frame_of(spark: SparkSession, rows: list[dict[str, Any]], schema: T.StructType | None = None) -> DataFrame:
    """Rows of any fields: their union, null-filled. A field of whole and other numbers is DOUBLE, one of other mixed kinds STRING."""
    names = list(dict.fromkeys(n for r in rows for n in r))
    fields = []
    values = {n: [_plain(r.get(n)) for r in rows] for n in names}
    for n in names:
        if schema is not None and n in schema.names:
            fields.append(schema[n])
            continue
        kinds = {type(v) for v in values[n] if v is not None}
        if kinds == {int, float}:
            values[n] = [None if v is None else float(v) for v in values[n]]
        elif len(kinds) > 1 and not kinds <= {dict} and not kinds <= {list, tuple}:
            values[n] = [None if v is None else str(v) for v in values[n]]
        kind: T.DataType = T.NullType()
        for v in values[n]:
            if v is not None:
                kind = T._merge_type(kind, T._infer_type(v, infer_dict_as_struct=True, prefer_timestamp_ntz=True))
        fields.append(T.StructField(n, _no_null(kind)))
    struct = T.StructType([*fields, T.StructField(POS, T.LongType())])
    data = [(*v, i) for i, v in enumerate(zip(*(values[n] for n in names), strict=True))] if names else [(i,) for i in range(len(rows))]
    return spark.createDataFrame(data, struct).withColumn(PART, F.lit(0).cast("bigint"))


def _no_null(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_no_null(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _no_null(f.dataType)) for f in kind.fields])
    return kind


def delimited(spark: SparkSession, source: Any, encoding: str = "utf-8", delimiter: str = ",", fieldnames: str | Iterable[str] | None = None, **options: Any) -> DataFrame:
    """All columns as text, an empty cell as an empty text, a missing one as null. More cells than names raise an error."""
    names = fieldnames.split() if isinstance(fieldnames, str) else list(fieldnames) if fieldnames else None
    if splittable(source) and not set(options) - {"quotechar", "escapechar", "multiline"}:
        quote = options.get("quotechar", '"')
        read = spark.read.option("sep", delimiter).option("encoding", encoding).option("quote", quote).option("escape", options.get("escapechar", '"'))
        # quoted line ends need whole files in a task; without multiline files are split
        read = read.option("multiLine", options.get("multiline", True)).option("nullValue", "\u0001none").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        header = names or read.option("header", True).csv(str(source)).columns
        # without column pruning, each row of another number of cells than names is kept as it was read
        read = read.option("header", names is None).option("columnPruning", False).option("columnNameOfCorruptRecord", "_wf_bad")
        df = read.schema(T.StructType([T.StructField(n, T.StringType()) for n in [*header, "_wf_bad"]])).csv(str(source))
        mark = re.escape(quote)
        cells = F.regexp_count(F.regexp_replace("_wf_bad", f"{mark}([^{mark}]|{mark}{mark})*{mark}", ""), F.lit(re.escape(delimiter))) + 1
        wrong = F.raise_error(F.concat(F.lit("insufficient/invalid column names in header: "), F.coalesce(F.col(f"`{header[0]}`"), F.lit(""))))
        df = df.where(F.when(cells > len(header), wrong.cast("boolean")).otherwise(F.lit(True)))
        there = lambda i: F.col("_wf_bad").isNull() | (cells > i)
        return df.select(*[F.when(there(i), F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for i, c in enumerate(header)])
    url = {k: options.pop(k) for k in URL_OPTIONS if k in options}
    zippath = options.pop("zippath", None)
    options.pop("multiline", None)
    reader = csv.DictReader(io.StringIO(read_text(source, encoding, zippath, **url)), fieldnames=names, delimiter=delimiter, **options)
    rows = list(reader)
    if any(None in r for r in rows):
        raise Exception("insufficient/invalid column names in header")  # noqa: TRY002
    header = list(reader.fieldnames or [])
    text = T.StructType([T.StructField(n, T.StringType()) for n in header])
    return frame_of(spark, rows, text) if rows else spark.createDataFrame([], text)


def json_rows(spark: SparkSession, source: Any, encoding: str = "utf-8", streaming: bool = False, path: str = "", json_decoder: Any = None, **options: Any) -> DataFrame:
    """An array of objects, under a dotted path if one is given, or objects one after the other."""
    lines = streaming or str(source).endswith(".jsonl") if isinstance(source, (str, Path)) and kind_of(source) != "string" else streaming
    if lines and path:
        raise ValueError("a path needs a whole document, not a stream of objects")
    if lines and splittable(source) and json_decoder is None:
        return spark.read.option("encoding", encoding).option("mode", "FAILFAST").json(str(source))
    url = {k: options[k] for k in URL_OPTIONS if k in options}
    text = read_text(source, encoding, options.get("zippath"), **url)
    decoder = json_decoder() if isinstance(json_decoder, type) else json_decoder or json.JSONDecoder()
    rows: Any
    if lines:
        rows, at = [], 0
        while at < len(text):  # objects may span lines
            if text[at].isspace():
                at += 1
                continue
            value, at = decoder.raw_decode(text, at)
            rows.append(value)
    else:
        rows = decoder.decode(text)
        for key in [p for p in path.split(".") if p]:
            if not isinstance(rows, dict) or key not in rows:
                raise PathNotFoundError(path)
            rows = rows[key]
        if isinstance(rows, dict):
            rows = [rows]
    return frame_of(spark, rows)


def excel_rows(spark: SparkSession, source: Any, sheet: str | None = None, fieldnames: str | Iterable[str] | None = None) -> DataFrame:
    """A worksheet; needs openpyxl."""
    try:
        import openpyxl
    except ImportError:
        raise RuntimeError("reading spreadsheets needs openpyxl") from None
    book = openpyxl.load_workbook(source, read_only=True, data_only=True)
    rows = (book[sheet] if sheet else book.active).iter_rows(values_only=True)
    names = fieldnames.split() if isinstance(fieldnames, str) else list(fieldnames) if fieldnames else [str(n) for n in next(rows)]
    return frame_of(spark, [dict(zip(names, r, strict=False)) for r in rows])


class FixedWidthReader:
    """Iterates the rows of fixed-width text as dicts. A slice is (label, start[, end[, function]]); an end that is left out is the next start, the function
    str.strip; a label of None is a gap. Blank lines are skipped. frame() reads the same with Spark.
    """

    def __init__(self, slice_spec: Iterable[tuple], src_file: Any, encoding: str = "utf-8"):
        spec = [(*s, *[None] * (4 - len(s))) for s in slice_spec]
        starts = [s[1] for s in spec][1:] + [None]
        self.slices = [(label.lower(), a, b if b is not None else nxt, fn or str.strip) for (label, a, b, fn), nxt in zip(spec, starts, strict=True) if label is not None]
        self.source, self.encoding = src_file, encoding

    def __iter__(self) -> Iterator[dict[str, Any]]:
        for line in lines_of(self.source):
            line = line.rstrip("\n")
            if line.strip():
                yield {label: fn(line[a:b]) for label, a, b, fn in self.slices}

    def frame(self, spark: SparkSession) -> DataFrame:
        if not splittable(self.source) or any(fn is not str.strip and not isinstance(fn, Converter) for *_, fn in self.slices):
            return frame_of(spark, list(self))
        raw = spark.read.text(str(self.source)).where(F.trim("value") != "")
        out = []
        for label, a, b, fn in self.slices:
            part = F.substring("value", a + 1, (b - a) if b is not None else 1 << 30)
            out.append((F.trim(part) if fn is str.strip else fn(part)).alias(label))
        return raw.select(*out)


def _column(fn: Any, c: Column, default: Any, kind: T.DataType | None) -> Column:
    """fn over a text column; what it can't convert becomes the default."""
    native = {int: "bigint", float: "double", str: "string", bool: None}
    if fn in native if isinstance(fn, type) else False:
        out = (c != "") if fn is bool else F.trim(c).try_cast(native[fn])
    elif isinstance(fn, Converter):
        out = fn(c)
    elif isinstance(fn, Column):
        out = fn
    elif not callable(fn):
        return F.lit(fn)
    else:
        try:
            out = fn(c)
        except Exception:  # it needs real values  # noqa: BLE001
            out = None
        if not isinstance(out, Column):

            kind = kind or T.StringType()

            def run(v: Any) -> Any:
                try:
                    return fitted(fn(v), kind)
                except Exception:  # noqa: BLE001
                    return default

            return F.udf(run, kind)(c)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def shaped(df: DataFrame, transforms: dict[str, Any] | None, filters: dict[str, Any] | None, limit: int | None) -> DataFrame:
    """Transforms, then filters (all must hold), then the limit. '*' converts all columns without a transform of their own; a column of which '*' can't
    convert every value stays as it is, unless a default is given.
    """
    transforms = dict(transforms or {})
    every = transforms.pop("*", None)
    data = [c for c in df.columns if not c.startswith("_wf_")]
    how = {n: transforms.get(n, every) for n in data if n in transforms or every is not None}
    parts = {n: h if isinstance(h, tuple) else (h, None) for n, h in how.items()}
    kinds = _kinds_of(df, {n: fn for n, (fn, _) in parts.items() if callable(fn) and not isinstance(fn, (type, Converter))})
    made = {n: _column(fn, F.col(f"`{n}`"), default, kinds.get(n)) for n, (fn, default) in parts.items()}
    wild = [n for n in made if n not in transforms and not isinstance(every, tuple)]
    if wild:  # one pass for all columns
        whole = df.agg(*[F.bool_and(made[n].isNotNull() | F.col(f"`{n}`").isNull()).alias(f"w{i}") for i, n in enumerate(wild)]).first()
        made = {n: c for n, c in made.items() if n not in wild or whole[wild.index(n)] is not False}
    if made:
        df = df.withColumns(made)
    for name, fn in transforms.items():
        if name not in data and not callable(fn):
            df = df.withColumn(name, F.lit(fn))
    for name, test in (filters or {}).items():
        df = df.where(value_test(test, F.col(f"`{name}`")))
    if limit is not None:
        order = [F.col(PART), F.col(POS)] if POS in df.columns else []
        df = df.orderBy(*order).limit(limit) if order else df.limit(limit)
    return df


def _kinds_of(df: DataFrame, functions: dict[str, Callable[[Any], Any]]) -> dict[str, T.DataType]:
    """The type of each Python function's results over its whole column."""
    native = {}
    for n, fn in functions.items():
        try:
            native[n] = isinstance(fn(F.col(f"`{n}`")), Column)
        except Exception:  # it needs real values  # noqa: BLE001
            native[n] = False
    return {n: kind_over(df, fn, F.col(f"`{n}`"), "default") for n, fn in functions.items() if not native[n]}


__all__ = ["FixedWidthReader", "delimited", "excel_rows", "fetch_url", "frame_of", "json_rows", "shaped"]

"""Group summaries from known functions, Columns, or Python functions over a group's rows."""

from __future__ import annotations

import statistics
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.order import visible
from .record import fitted, namespace

NATIVE: dict[Any, Callable[[Column], Column]] = {
    sum: F.sum,
    min: F.min,
    max: F.max,
    statistics.mean: F.avg,
    statistics.median: F.median,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "avg": F.avg,
    "median": F.median,
    "count": F.count,
    "stddev": F.stddev_samp,
    "variance": F.var_samp,
}


def aggregate(fn: Any, col: str | Column | None = None) -> Column | None:
    """The native aggregate for len, (function, column), a Column, or a function over a column; None if there is none."""
    if isinstance(fn, Column):
        return fn
    if fn is len:
        return F.count("*")
    if isinstance(fn, tuple):
        return aggregate(fn[0], fn[1])
    try:
        native = NATIVE.get(fn)
    except TypeError:
        native = None
    if native is None or col is None:
        return None
    return native(F.col(f"`{col}`") if isinstance(col, str) else col)


def summarized(df: DataFrame, keys: list[str], outputs: dict[str, Any], types: dict[str, T.DataType | str] | None = None) -> DataFrame:
    """keys and outputs. Native aggregates go to Catalyst, with partial aggregation; a Python function gets the group's rows, which then meet in one task."""
    native = {k: aggregate(v) for k, v in outputs.items()}
    python = {k: v for k, v in outputs.items() if native[k] is None}
    by = [F.col(f"`{k}`") for k in keys]
    fast = df.groupBy(*by).agg(*[c.alias(k) for k, c in native.items() if c is not None]) if len(python) < len(outputs) else df.select(*by).distinct()
    if not python:
        return fast.select(*by, *outputs)
    rows = df.select(*[F.col(f"`{c}`") for c in visible(df)])
    kinds = {k: (types or {}).get(k) or _sampled(rows, by, fn) for k, fn in python.items()}
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(k, T._parse_datatype_string(v) if isinstance(v, str) else v) for k, v in kinds.items()])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        recs = [namespace_of(r) for r in pdf.to_dict("records")]
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, **{k: [fitted(fn(recs), schema[k].dataType)] for k, fn in python.items()}})

    slow = rows.groupBy(*by).applyInPandas(run, schema)
    if len(python) < len(outputs):
        slow = fast.alias("f").join(slow.alias("s"), [F.col(f"f.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]).select(*[F.col(f"f.`{k}`") for k in keys], *[F.col(f"{'s' if o in python else 'f'}.`{o}`") for o in outputs])
    return slow.select(*by, *outputs)


def namespace_of(record: dict[str, Any]) -> Any:
    from types import SimpleNamespace

    return SimpleNamespace(**{k: None if isinstance(v, float) and v != v else v for k, v in record.items()})


def _sampled(rows: DataFrame, by: list[Column], fn: Callable[[Any], Any]) -> T.DataType:
    """By a few rows; a group's result that is of another type raises an error."""
    value = fn([namespace(r) for r in rows.limit(50).collect()])
    return T._infer_type(value) if value is not None else T.StringType()

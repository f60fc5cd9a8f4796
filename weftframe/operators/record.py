"""Callables over rows: turned into Columns by calling them once on a proxy, or run row by row where that can't be."""

from __future__ import annotations

import string
from collections.abc import Callable
from types import SimpleNamespace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.order import visible


class Record:
    """Attributes and items are the frame's columns."""

    def __init__(self, df: DataFrame):
        self.__dict__["_df"] = df

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__") or name not in self._df.columns:
            raise AttributeError(name)
        return F.col(f"`{name}`")

    __getitem__ = __getattr__


def namespace(value: Any) -> Any:
    if isinstance(value, Row):
        return SimpleNamespace(**{k: namespace(v) for k, v in value.asDict().items()})
    return value


def kind_name(value: Any) -> str | None:
    """The type of a value as text; None for no value."""
    kind = T._infer_type(value, infer_dict_as_struct=True, prefer_timestamp_ntz=True)
    return None if isinstance(kind, T.NullType) else kind.json()


def merged(kinds: list[T.DataType]) -> T.DataType:
    """Whole and other numbers become DOUBLE, structures the union of their fields, other mixtures text."""
    if not kinds:
        return T.StringType()
    if all(isinstance(k, T.NumericType) and not isinstance(k, T.DecimalType) for k in kinds):
        return kinds[0] if len({*kinds}) == 1 else T.DoubleType()
    out = kinds[0]
    try:
        for k in kinds[1:]:
            out = T._merge_type(out, k)
    except Exception:  # they don't go together  # noqa: BLE001
        return T.StringType()
    return out


def kind_over(df: DataFrame, fn: Callable[[Any], Any], arg: Column, errors: str = "raise") -> T.DataType:
    """The type that holds fn's results over all rows: a pass of its own."""

    def run(value: Any) -> str | None:
        try:
            return kind_name(fn(value))
        except Exception:  # its default will do, or it will be raised when the values are wanted
            if errors == "raise":
                raise
            return None

    found = df.select(F.udf(run, T.StringType())(arg).alias("k")).where("k is not null").distinct().collect()  # as many rows as types
    return merged([T._parse_datatype_json_string(r[0]) for r in sorted(found)])


def fitted(value: Any, kind: T.DataType) -> Any:
    """The value as a column of that type takes it; a value it can't hold raises an error, where Spark would give null."""
    if value is None:
        return None
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(value, int):
        return float(value)
    if isinstance(kind, T.IntegralType) and (isinstance(value, bool) or not isinstance(value, int)):
        if isinstance(value, float) and value.is_integer() or hasattr(value, "__index__"):
            return int(value)
        raise TypeError(f"{value!r} is no {kind.simpleString()}")
    return value


def row_column(df: DataFrame, fn: Callable[[Any], Any], returns: T.DataType | str | None = None, errors: str = "raise", default: Any = None) -> Column:
    """The Column of fn over rows. errors: 'raise', or 'default', which puts default where fn raises or, for a native Column, where it is null."""
    try:
        out = fn(Record(df))
    except Exception:  # it needs real rows  # noqa: BLE001
        out = None
    if isinstance(out, Column):
        return F.coalesce(out, F.lit(default)) if errors == "default" and default is not None else out
    names = visible(df)
    row = F.struct(*[F.col(f"`{n}`") for n in names])
    if returns is None:
        returns = kind_over(df, lambda r: fn(namespace(r)), row, errors)
        if errors == "default" and default is not None:
            returns = merged([k for k in (returns, T._parse_datatype_json_string(kind_name(default))) if k is not None])
    kind = T._parse_datatype_string(returns) if isinstance(returns, str) else returns

    def run(row: Row) -> Any:
        try:
            value = fn(namespace(row))
        except Exception:
            if errors == "raise":
                raise
            value = default
        return fitted(value, kind)

    return F.udf(run, kind)(row)


def template(df: DataFrame, text: str) -> Column:
    """A str.format template over the row, `{name}` or `{0.name}`; plain fields are concatenated natively."""
    pieces, native = [], True
    for literal, field, spec, conversion in string.Formatter().parse(text):
        if literal:
            pieces.append(F.lit(literal))
        if field is None:
            continue
        name = field[2:] if field.startswith(("0.", ".")) else field
        if spec or conversion or name not in df.columns or dict(df.dtypes)[name] not in ("string", "int", "bigint"):
            native = False
            break
        pieces.append(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("None")))
    if native:
        return F.concat(*pieces) if pieces else F.lit("")
    names = visible(df)

    def run(row: Row) -> str:
        ns = namespace(row)
        return text.format(ns, **vars(ns))

    return F.udf(run, T.StringType())(F.struct(*[F.col(f"`{n}`") for n in names]))

"""Conversions of text columns. Each function returns a Converter: Columns become Columns; plain values convert too."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strptime directives and their patterns; a format with any other directive goes through Python
_DIRECTIVES = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "y": "yy", "b": "MMM", "B": "MMMM", "j": "D", "I": "h", "p": "a"}


class Converter:
    def __init__(self, build: Callable[[Column], Column], convert: Callable[[Any], Any]):
        self.build, self.convert = build, convert

    def __call__(self, value: Any) -> Any:
        return self.build(value) if isinstance(value, Column) else self.convert(value)


def pattern_of(fmt: str) -> str | None:
    out, i, text = [], 0, ""
    while i < len(fmt):
        if fmt[i] == "%":
            code = fmt[i + 1 : i + 2]
            if code != "%" and code not in _DIRECTIVES:
                return None
            if code == "%":
                text += "%"
            else:
                if text:
                    out.append("'" + text.replace("'", "''") + "'")
                    text = ""
                out.append(_DIRECTIVES[code])
            i += 2
        else:
            text += fmt[i]
            i += 1
    if text:
        out.append("'" + text.replace("'", "''") + "'")
    return "".join(out)


def _parsed(value: Any, fmt: str, finish: Callable[[dt.datetime], Any], empty: Any, on_error: Any) -> Any:
    if value is None or value == "":
        return empty or None
    try:
        return finish(dt.datetime.strptime(value, fmt))
    except (TypeError, ValueError):
        return on_error


def _timestamp(c: Column, fmt: str) -> Column:
    pattern = pattern_of(fmt)
    if pattern is None:
        return F.udf(lambda v: _parsed(v, fmt, lambda d: d, None, None), "timestamp_ntz")(c)
    if not any(d in fmt for d in ("%Y", "%y")):  # strptime's year where there is none
        c, pattern = F.concat(F.lit("1900-01-01 "), c), "yyyy-MM-dd " + pattern
    return F.try_to_timestamp(F.when(c != "", c), F.lit(pattern)).cast("timestamp_ntz")


def _filled(c: Column, out: Column, empty: Any, on_error: Any) -> Column:
    if on_error is not None:
        out = F.coalesce(out, F.when(c.isNotNull() & (c != ""), F.lit(on_error)))
    if empty not in (None, ""):
        out = F.when(c.isNull() | (c == ""), F.lit(empty)).otherwise(out)
    return out


def parse_datetime(fmt: str, empty: Any = "", on_error: Any = None) -> Converter:
    """Text to timestamp_ntz by a strptime format."""
    return Converter(lambda c: _filled(c, _timestamp(c, fmt), empty, on_error), lambda v: _parsed(v, fmt, lambda d: d, empty, on_error))


def parse_date(fmt: str, empty: Any = "", on_error: Any = None) -> Converter:
    """Text to date by a strptime format."""
    return Converter(lambda c: _filled(c, _timestamp(c, fmt).cast("date"), empty, on_error), lambda v: _parsed(v, fmt, lambda d: d.date(), empty, on_error))


def parse_timedelta(fmt: str, reference_time: dt.datetime = dt.datetime(1900, 1, 1), empty: Any = "", on_error: Any = None) -> Converter:
    """Text to a day-time interval: the parsed time less the reference time."""
    start = F.lit(reference_time.isoformat(" ")) if reference_time else None
    return Converter(
        lambda c: _filled(c, _timestamp(c, fmt) - start.cast("timestamp_ntz"), empty, on_error),
        lambda v: _parsed(v, fmt, lambda d: d - reference_time, empty, on_error),
    )


def convert_numeric(s: Any = None, empty: Any = "", non_numeric: Any = object, force_float: bool = False) -> Any:
    """Numbers from text. A Column becomes DOUBLE: an empty text becomes `empty` where that is a number, other text `non_numeric` where that is one,
    else both null; plain values become int or float, and other text stays unless non_numeric is given. Without s: a Converter.
    """

    def one(v: Any) -> Any:
        if v is None or v == "":
            return empty
        for kind in (float,) if force_float else (int, float):
            try:
                return kind(v)
            except (TypeError, ValueError):
                pass
        return v if non_numeric is object else non_numeric

    def build(c: Column) -> Column:
        number = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else F.lit(None).cast("double")
        text = c.cast("string")
        return F.when(text.isNull() | (text == ""), number(empty)).otherwise(F.coalesce(text.try_cast("double"), number(non_numeric)))

    made = Converter(build, one)
    return made if s is None else made(s)

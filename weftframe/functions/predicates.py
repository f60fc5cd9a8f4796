"""Comparators that follow two-valued logic. In a filter a null test is false, so the bare test, which scans can push down, will do there."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Predicate:
    """A test of one column; calling it tests a plain Python value."""

    def __init__(self, name: str, build: Callable[[Column], Column], test: Callable[[Any], bool]):
        self.name, self.build, self.test = name, build, test

    def to_column(self, col: Column) -> Column:
        return F.coalesce(self.build(col), F.lit(False))

    def __call__(self, value: Any) -> bool:
        try:
            return bool(self.test(value))
        except TypeError:
            return False

    def __repr__(self) -> str:
        return self.name


def lt(v: Any) -> Predicate:
    return Predicate(f"lt({v!r})", lambda c: c < v, lambda x: x < v)


def le(v: Any) -> Predicate:
    return Predicate(f"le({v!r})", lambda c: c <= v, lambda x: x <= v)


def gt(v: Any) -> Predicate:
    return Predicate(f"gt({v!r})", lambda c: c > v, lambda x: x > v)


def ge(v: Any) -> Predicate:
    return Predicate(f"ge({v!r})", lambda c: c >= v, lambda x: x >= v)


def eq(v: Any) -> Predicate:
    return Predicate(f"eq({v!r})", lambda c: c.eqNullSafe(v), lambda x: x == v)


def ne(v: Any) -> Predicate:
    return Predicate(f"ne({v!r})", lambda c: ~c.eqNullSafe(v), lambda x: x != v)


def is_none() -> Predicate:
    return Predicate("is_none()", lambda c: c.isNull(), lambda x: x is None)


def is_not_none() -> Predicate:
    return Predicate("is_not_none()", lambda c: c.isNotNull(), lambda x: x is not None)


def is_null() -> Predicate:
    """None or an empty string."""
    return Predicate("is_null()", lambda c: c.isNull() | (c.cast("string") == ""), lambda x: x is None or x == "")


def is_not_null() -> Predicate:
    return Predicate("is_not_null()", lambda c: c.isNotNull() & (c.cast("string") != ""), lambda x: x is not None and x != "")


def _listed(values: Iterable[Any]) -> tuple[list[Any], bool]:
    values = list(values)
    return [v for v in values if v is not None], any(v is None for v in values)


def is_in(values: Iterable[Any]) -> Predicate:
    some, none = _listed(values)
    found = lambda c: c.isin(some) if some else F.lit(False)
    return Predicate("is_in(...)", lambda c: (found(c) | c.isNull()) if none else found(c), lambda x: x in some or (none and x is None))


def not_in(values: Iterable[Any]) -> Predicate:
    """Null passes unless it is listed."""
    some, none = _listed(values)
    out = lambda c: ~c.isin(some) if some else F.lit(True)
    return Predicate("not_in(...)", lambda c: (out(c) & c.isNotNull()) if none else (out(c) | c.isNull()), lambda x: x not in some and not (none and x is None))


def startswith(s: str) -> Predicate:
    return Predicate(f"startswith({s!r})", lambda c: c.cast("string").startswith(s), lambda x: x is not None and str(x).startswith(s))


def endswith(s: str) -> Predicate:
    return Predicate(f"endswith({s!r})", lambda c: c.cast("string").endswith(s), lambda x: x is not None and str(x).endswith(s))


def between(low: Any, high: Any) -> Predicate:
    """Without both ends."""
    return Predicate(f"between({low!r}, {high!r})", lambda c: (c > low) & (c < high), lambda x: low < x < high)


def within(low: Any, high: Any) -> Predicate:
    """With both ends."""
    return Predicate(f"within({low!r}, {high!r})", lambda c: (c >= low) & (c <= high), lambda x: low <= x <= high)


def in_range(low: Any, high: Any) -> Predicate:
    """With the lower end only."""
    return Predicate(f"in_range({low!r}, {high!r})", lambda c: (c >= low) & (c < high), lambda x: low <= x < high)


def of_regex(method: Any) -> Callable[[Column], Column] | None:
    """A Column builder for a compiled expression's match, search or fullmatch; None for anything else."""
    pattern, name = getattr(method, "__self__", None), getattr(method, "__name__", "")
    if not isinstance(pattern, re.Pattern) or name not in ("match", "search", "fullmatch"):
        return None
    flags = "".join(f for f, bit in (("i", re.IGNORECASE), ("m", re.MULTILINE), ("s", re.DOTALL), ("x", re.VERBOSE)) if pattern.flags & bit)
    flags += "U" if pattern.flags & re.UNICODE else ""
    head = f"(?{flags})" if flags else ""
    body = {"search": pattern.pattern, "match": rf"\A(?:{pattern.pattern})", "fullmatch": rf"\A(?:{pattern.pattern})\z"}[name]
    return lambda c: c.cast("string").rlike(head + body)


def value_test(test: Any, col: Column) -> Column:
    """The Column for `attr=test`, null or false where it fails: a comparator, a regular expression's method, a callable, or a value to equal."""
    if isinstance(test, Predicate):
        return test.build(col)
    if not callable(test):
        return col.eqNullSafe(test)
    build = of_regex(test)
    if build:
        return build(col)
    try:
        out = test(col)
        if isinstance(out, Column):
            return out.cast("boolean")
    except Exception:  # it needs real values  # noqa: BLE001
        pass

    def safe(value: Any) -> bool:
        try:
            return bool(test(value))
        except Exception:  # a failing test is false  # noqa: BLE001
            return False

    return F.udf(safe, T.BooleanType())(col)

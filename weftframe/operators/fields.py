"""Field lists, sort keys and attribute getters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from ..plans.order import Key


def parse_fields(fields: str | Iterable[str] | None, columns: list[str]) -> list[str]:
    """`a b`, `* -a` (all but a), `-a` alone (the same), `a *` (a, then all others)."""
    names = fields.split() if isinstance(fields, str) else list(fields or ["*"])
    dropped = {n[1:] for n in names if n.startswith("-") and n not in columns}
    kept = [n for n in names if n in columns or not n.startswith("-")]
    if not kept and dropped:
        kept = ["*"]
    others = [c for c in columns if c not in kept and c not in dropped]
    out: list[str] = []
    for n in kept:
        out += others if n == "*" else [n]
    return [n for n in dict.fromkeys(out) if n not in dropped]


def parse_sort(key: str | Iterable[Any], reverse: bool = False) -> list[Key]:
    """`a, b desc` or a list of names, `b desc` texts and (name, order) pairs; reverse turns every direction."""
    items = [k.strip() for k in key.split(",")] if isinstance(key, str) else list(key)
    out = []
    for item in items:
        name, order = (item[0], str(item[1])) if isinstance(item, tuple) else (*re.split(r"\s+", item.strip(), maxsplit=1), "")[:2]
        if order.lower() not in ("", "asc", "desc"):
            raise ValueError(f"{order!r} is no sort order")
        out.append(Key(name, (order.lower() == "desc") != reverse))
    return out


def attrgetter(item: str, *items: str, defaults: dict[str, Any] | None = None) -> Callable[[Any], tuple]:
    """A function that gives a tuple of a row's attributes, of one attribute as well; a missing one is its default, or None."""
    given = defaults or {}

    def one(row: Any, path: str) -> Any:
        for name in path.split("."):
            try:
                row = row[name] if isinstance(row, dict) else getattr(row, name)
            except (AttributeError, KeyError):
                return given.get(path)
        return row

    return lambda row: tuple(one(row, p) for p in (item, *items))

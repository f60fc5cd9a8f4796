"""Rows as HTML, Markdown and plain text; for as many rows as a reader would look at."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from decimal import Decimal
from typing import Any

RIGHT = (int, float, Decimal, dt.timedelta)
MARKS = {"Y", "N", "X", "YES", "NO", "y", "n", "x", "yes", "no", "0", "1", "", None, True, False}


def formatter(formats: dict[Any, Any] | None) -> Callable[[str, Any], str]:
    formats = formats or {}

    def run(name: str, value: Any) -> str:
        how = formats.get(name, formats.get(type(value), "{}"))
        return how.format(value) if isinstance(how, str) else how(value)

    return run


def suppressed(names: list[str], rows: Iterable[list[Any]], group: list[str] | None) -> Iterable[tuple[list[Any], set[str]]]:
    """Rows with the group fields to leave blank: those that repeat, as long as all before them repeat."""
    at = [names.index(g) for g in group or [] if g in names]
    last: list[Any] | None = None
    for row in rows:
        blank: set[str] = set()
        for i in at if last is not None else []:
            if row[i] != last[i]:
                break
            blank.add(names[i])
        yield row, blank
        last = row


def html(names: list[str], rows: Iterable[list[Any]], formats: dict[Any, Any] | None, group: list[str] | None, properties: dict[str, Any] | None) -> str:
    text = formatter(formats)
    cell = lambda v, s: f'<td><div align="{"right" if isinstance(v, RIGHT) and s is not None else "left"}">{s or ""}</div></td>'
    body = "".join(
        "<tr>" + "".join(cell(v, None if n in blank else text(n, v)) for n, v in zip(names, row, strict=True)) + "</tr>\n"
        for row, blank in suppressed(names, rows, group)
    )
    head = "".join(f'<th><div align="center">{n}</div></th>' for n in names)
    extra = "".join(f' {k}="{v}"' for k, v in (properties or {}).items())
    return f"<table{extra}>\n<thead>\n<tr>{head}</tr>\n</thead>\n<tbody>{body}</tbody>\n</table>"


def alignment(values: list[Any]) -> str:
    hashable = [v for v in values if not isinstance(v, (list, dict, set))]
    if len(hashable) < len(values):
        return "---"
    if all(v is None or v == "" or isinstance(v, RIGHT) for v in values):
        return "---:"
    return ":---:" if all(v in MARKS for v in values) else "---"


def markdown(names: list[str], rows: list[list[Any]], formats: dict[Any, Any] | None, group: list[str] | None) -> str:
    text = formatter(formats)
    lines = [f"| {' | '.join(names)} |", f"|{'|'.join(alignment([r[i] for r in rows]) for i in range(len(names)))}|"]
    for row, blank in suppressed(names, rows, group):
        lines.append("|" + "".join(f" {'' if n in blank else text(n, v)} |" for n, v in zip(names, row, strict=True)))
    return "\n".join(lines) + "\n"


def plain(names: list[str], rows: list[list[Any]], group: list[str] | None, width: int | None = None, title: str = "", caption: str | None = None, show_header: bool = True, show_lines: bool = False) -> str:
    """An ASCII table: numbers to the right, columns of single characters centred, headings in title case; a title above and a caption below."""
    heads = [n.replace("_", " ").title() for n in names]
    cells = [["" if n in blank else str(v) for n, v in zip(names, row, strict=True)] for row, blank in suppressed(names, rows, group)]
    wide = [max([len(h) if show_header else 0, *(len(c[i]) for c in cells)]) for i, h in enumerate(heads)]
    numbers = [bool(rows) and all(v is None or isinstance(v, RIGHT) for v in (r[i] for r in rows)) for i in range(len(names))]
    single = [all(len(c[i]) <= 1 for c in cells) for i in range(len(names))]

    def one(i: int, s: str) -> str:
        return s.rjust(wide[i]) if numbers[i] else s.center(wide[i]) if single[i] else s.ljust(wide[i])

    bar = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    lines = [title.center(len(bar)).rstrip()] if title else []
    lines.append(bar)
    if show_header:
        lines += ["| " + " | ".join(h.ljust(wide[i]) for i, h in enumerate(heads)) + " |", bar]
    for k, c in enumerate(cells):
        if show_lines and k:
            lines.append(bar)
        lines.append("| " + " | ".join(one(i, s) for i, s in enumerate(c)) + " |")
    lines.append(bar)
    if caption:
        lines.append(caption.center(len(bar)).rstrip())
    return "\n".join(x[:width] if width else x for x in lines) + "\n"

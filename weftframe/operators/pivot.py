"""Dense pivots over one to three fields: every pair of the first two fields' values has a cell, and every third value that its first has."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import product
from .grouping import aggregate, summarized

if TYPE_CHECKING:
    from ..table import Table


class Pivot:
    def __init__(self, table: Table, fields: list[str], path: tuple[tuple[str, Any], ...] = ()):
        self.table, self.fields, self.path = table, fields, path

    @property
    def known(self) -> DataFrame:
        """Rows without nulls in the pivot's fields."""
        return self.table.df.where(" and ".join(f"`{f}` is not null" for f in self.fields))

    def grid(self) -> DataFrame:
        values = lambda *f: self.table.df.where(" and ".join(f"`{x}` is not null" for x in f)).select(*[F.col(f"`{x}`") for x in f]).distinct()
        out = product([values(f) for f in self.fields[:2]])
        if len(self.fields) > 2:
            out = out.join(values(self.fields[0], self.fields[2]), self.fields[0])
        return out

    def cells(self, fn: Any = None, col: str | None = None, label: str = "value") -> DataFrame:
        """fields and one value a cell; a count is 0 where there are no rows."""
        native = F.count("*") if fn is None or fn is len else aggregate(fn, col)
        if native is not None:
            found = self.known.groupBy(*[F.col(f"`{f}`") for f in self.fields]).agg(native.alias(label))
        else:
            own = (lambda rows: fn([getattr(r, col) for r in rows])) if col else fn
            found = summarized(self.known, self.fields, {label: own})
        out = self.grid().join(found, self.fields, "left")
        if fn is None or fn is len or fn in (sum, "sum", "count"):
            out = out.withColumn(label, F.coalesce(label, F.lit(0)))
        return out.select(*self.fields, label)

    def as_table(self, fn: Any = None, col: str | None = None, col_label: str | None = None) -> Table:
        if col_label is None:
            name = getattr(fn, "__name__", str(fn))
            col_label = "Count" if fn is None or fn is len else f"{name}_{col}" if col else "value"
        out = self.table._derived(self.cells(fn, col, col_label), [])
        out._indexes = {f: self.table._index_spec(False) for f in self.fields}
        return out.orderby(",".join(self.fields))

    summary_counts = as_table

    def keys(self) -> list[Any]:
        f = self.fields[0]
        return sorted(r[0] for r in self.table.df.where(F.col(f"`{f}`").isNotNull()).select(F.col(f"`{f}`")).distinct().toLocalIterator())

    def __getitem__(self, key: Any) -> Any:
        f = self.fields[0]
        rows = self.table._derived(self.table.df.where(F.col(f"`{f}`").eqNullSafe(key)))
        return Pivot(rows, self.fields[1:], (*self.path, (f, key))) if len(self.fields) > 1 else rows

    def values(self) -> list[Any]:
        return [self[k] for k in self.keys()]

    def items(self) -> Iterator[tuple[Any, Any]]:
        return ((k, self[k]) for k in self.keys())

    def __iter__(self) -> Iterator[Any]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.table)

    def pivot_key(self) -> tuple[tuple[str, Any], ...]:
        return self.path

    def pivot_key_str(self) -> str:
        return "/".join(f"{f}:{v}" for f, v in self.path)

    def has_subtables(self) -> bool:
        return len(self.fields) > 0

    def dump(self, out: TextIO = sys.stdout, row_fn: Callable[[Any], str] = repr, limit: int = -1, indent: int = 0) -> None:
        """A listing by groups; groups without rows are left out."""
        for key, sub in self.items():
            if not len(sub):
                continue
            out.write(f"{'  ' * indent}{self.fields[0]}:{key}\n")
            if isinstance(sub, Pivot):
                sub.dump(out, row_fn, limit, indent + 1)
            else:
                for row in sub if limit < 0 else sub.head(limit):
                    out.write(f"{'  ' * (indent + 1)}{row_fn(row)}\n")
            out.flush()

    def _grid_values(self, fn: Any) -> tuple[list[Any], list[Any], dict[tuple[Any, ...], Any]]:
        rows = self.cells(fn).collect()  # a report: as many values as it shows
        first = sorted({r[0] for r in rows})
        second = sorted({r[1] for r in rows}) if len(self.fields) > 1 else []
        return first, second, {tuple(r)[:-1]: r[-1] for r in rows}

    def dump_counts(self, out: TextIO = sys.stdout, count_fn: Any = len, colwidth: int = 10) -> None:
        if len(self.fields) > 2:
            raise ValueError("only pivots over one or two fields have a grid of counts")
        first, second, value = self._grid_values(count_fn)
        out.write(f"Pivot: {','.join(self.fields)}\n")
        wide = max([colwidth, *(len(str(v)) for v in value.values()), *(len(str(k)) for k in second)])
        if not second:
            left = max((len(str(k)) for k in first), default=0)
            for k in first:
                out.write(f"{k!s:<{left}} {value[k,]:>{wide}}\n")
            return
        left = max([5, *(len(str(k)) for k in first)])
        line = lambda head, cells: out.write(f"{head:<{left}} " + " ".join(f"{c!s:>{wide}}" for c in cells) + "\n")
        line("", [*second, "Total"])
        for a in first:
            row = [value[a, b] for b in second]
            line(str(a), [*row, sum(row)])
        totals = [sum(value[a, b] for a in first) for b in second]
        line("Total", [*totals, sum(totals)])

    def summarize(self, count_fn: Any = len, col_label: str | None = None) -> Summary:
        if len(self.fields) > 2:
            raise ValueError("only pivots over one or two fields can be summarized")
        return Summary(self, count_fn, col_label or "Count")


class Summary:
    """A wide view with totals; shown as HTML."""

    def __init__(self, pivot: Pivot, fn: Any, label: str):
        self.fields, self.label = pivot.fields, label
        self.first, self.second, self.value = pivot._grid_values(fn)

    def rows(self) -> tuple[list[str], list[list[Any]]]:
        if not self.second:
            return [self.fields[0], self.label], [[k, self.value[k,]] for k in self.first]
        body = [[a, *(self.value[a, b] for b in self.second)] for a in self.first]
        body = [[*r, sum(r[1:])] for r in body]
        totals = [sum(r[i] for r in body) for i in range(1, len(self.second) + 2)]
        return [self.fields[0], *map(str, self.second), "Total"], [*body, ["Total", *totals]]

    def as_html(self, formats: dict[Any, Any] | None = None) -> str:
        from ..render import html

        names, body = self.rows()
        return html(names, body, formats, None, None)

    as_html_table = as_html

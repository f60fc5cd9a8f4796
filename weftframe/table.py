"""The table: a name, an immutable DataFrame that mutators replace, and an order of rows that is made only when an operation needs it."""

from __future__ import annotations

import datetime as dt
import sys
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, fields, is_dataclass
from types import SimpleNamespace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import render
from .errors import NoSuchIndexError, ReadonlyIndexAccessError, SearchIndexInconsistentError, UnableToExtractAttributeNamesError
from .functions import convert, predicates
from .operators import grouping, joins, pivot, record, search, stats
from .operators.fields import parse_fields, parse_sort
from .plans import order
from .plans.order import NUMBER, PART, POS, Key
from .sources import fetch, read, write


@dataclass
class IndexSpec:
    unique: bool = False
    accept_none: bool = False


def as_dict(row: Any) -> dict[str, Any]:
    """A row object's fields: mappings, Rows, named tuples, data classes, slots and plain objects."""
    if isinstance(row, dict):
        return dict(row)
    if isinstance(row, Row):
        return row.asDict()
    if hasattr(row, "_asdict"):
        return dict(row._asdict())
    if is_dataclass(row):
        return {f.name: getattr(row, f.name) for f in fields(row)}
    for name in ("model_dump", "trait_values"):
        if hasattr(row, name):
            return dict(getattr(row, name)())
    out = {s: getattr(row, s) for kind in type(row).__mro__ for s in getattr(kind, "__slots__", ()) if hasattr(row, s) and not s.startswith("__")}
    out |= {k: v.__dict__ if isinstance(v, SimpleNamespace) else v for k, v in getattr(row, "__dict__", {}).items() if not k.startswith("_")}
    if not out:
        raise UnableToExtractAttributeNamesError(f"{type(row).__name__} has no fields")
    return out


class Values:
    """A column's values in row order; .unique gives each once, as first seen."""

    def __init__(self, table: Table, name: str, distinct: bool = False):
        self.table, self.name, self.distinct = table, name, distinct

    @property
    def unique(self) -> Values:
        return Values(self.table, self.name, True)

    def frame(self) -> DataFrame:
        t = self.table
        if self.name not in t.columns:
            return t.df.select(F.lit(None).alias(self.name))
        out = t.unique(self.name) if self.distinct else t
        return out._sorted().select(F.col(f"`{self.name}`"))

    def __iter__(self) -> Iterator[Any]:
        return (r[0] for r in write.rows_of(self.frame()))

    def _one(self, aggregate: Callable[[Column], Column]) -> Any:
        """What the tasks find, where the built-in functions would bring all values to the driver."""
        if self.name not in self.table.columns:
            return None
        values = self.table.df.select(F.col(f"`{self.name}`").alias("v"))
        return (values.distinct() if self.distinct else values).agg(aggregate(F.col("v"))).first()[0]

    def sum(self) -> Any:
        return self._one(F.sum)

    def min(self) -> Any:
        return self._one(F.min)

    def max(self) -> Any:
        return self._one(F.max)

    def mean(self) -> Any:
        return self._one(F.avg)

    def count(self) -> int:
        """How many there are; nulls don't count."""
        return self._one(F.count) or 0

    def counts(self) -> DataFrame:
        """value and n: how often each value occurs."""
        return self.table.df.groupBy(F.col(f"`{self.name}`").alias("value")).agg(F.count("*").alias("n"))


class Accessor:
    """table.all, table.by and table.search: fields as attributes, or by call for other names."""

    def __init__(self, make: Callable[[str], Any], names: Callable[[], list[str]]):
        self._make, self._names = make, names

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._make(name)

    def __call__(self, name: str) -> Any:
        return self._make(name)

    def __dir__(self) -> list[str]:
        return self._names()


class Index:
    """Access by key: exact, by slices of keys, and key listings."""

    def __init__(self, table: Table, name: str, spec: IndexSpec):
        self._table, self._name, self._spec = table, name, spec

    @property
    def _col(self) -> Column:
        return F.col(f"`{self._name}`")

    def __getitem__(self, key: Any) -> Any:
        t = self._table
        if isinstance(key, slice):
            if key.step is not None or (key.start is None and key.stop is None):
                raise ValueError("an index slice has a start, an end or both, and no step")
            if key.start is not None and key.stop is not None and not key.start < key.stop:
                raise ValueError("an index slice must start before its end")
            out = t.df
            if key.start is not None:
                out = out.where(self._col >= F.lit(key.start))
            if key.stop is not None:
                out = out.where(self._col < F.lit(key.stop))
            return t._derived(out)
        found = t._derived(t.df.where(self._col.eqNullSafe(key)))
        if not self._spec.unique:
            return found
        row = found._first()
        if row is None:
            raise KeyError(key)
        return row

    def __setitem__(self, key: Any, value: Any) -> None:
        raise ReadonlyIndexAccessError(f"index {self._name!r} can't be written")

    __delitem__ = lambda self, key: self.__setitem__(key, None)

    def get(self, key: Any, default: Any = None) -> Any:
        try:
            out = self[key]
        except KeyError:
            return default
        return out if self._spec.unique or out else default if default is not None else out

    def __contains__(self, key: Any) -> bool:
        return not self._table.df.where(self._col.eqNullSafe(key)).isEmpty()

    def key_frame(self) -> DataFrame:
        return self._table.df.where(self._col.isNotNull()).select(self._col).distinct().orderBy(self._col)

    def keys(self) -> list[Any]:
        return [r[0] for r in write.rows_of(self.key_frame())]

    def items(self) -> Iterator[tuple[Any, Any]]:
        return ((k, self[k]) for k in self.keys())

    def values(self) -> Iterator[Any]:
        return (self[k] for k in self.keys())

    def __iter__(self) -> Iterator[Any]:
        return iter(Values(self._table, self._name, True))

    def __len__(self) -> int:
        return self._table.df.select(self._col).distinct().count()


class Table:
    """Rows with named fields.

    Order: rows come in the order in which they were inserted or read until orderby() gives another; operations keep it. Names of hidden columns begin with _wf_.
    """

    INNER_JOIN = "inner join"
    LEFT_OUTER_JOIN = "left outer join"
    RIGHT_OUTER_JOIN = "right outer join"
    FULL_OUTER_JOIN = "full outer join"
    OUTER_JOIN_TYPES = (LEFT_OUTER_JOIN, RIGHT_OUTER_JOIN, FULL_OUTER_JOIN)

    lt, le, gt, ge, eq, ne = (staticmethod(getattr(predicates, n)) for n in ("lt", "le", "gt", "ge", "eq", "ne"))
    is_none, is_not_none, is_null, is_not_null = (staticmethod(getattr(predicates, n)) for n in ("is_none", "is_not_none", "is_null", "is_not_null"))
    is_in, not_in, startswith, endswith = (staticmethod(getattr(predicates, n)) for n in ("is_in", "not_in", "startswith", "endswith"))
    between, within, in_range = (staticmethod(getattr(predicates, n)) for n in ("between", "within", "in_range"))
    convert_numeric, parse_datetime, parse_date, parse_timedelta = (staticmethod(getattr(convert, n)) for n in ("convert_numeric", "parse_datetime", "parse_date", "parse_timedelta"))

    def __init__(self, table_name: str = "", df: DataFrame | None = None, spark: SparkSession | None = None):
        self.table_name = table_name
        self._spark = spark or (df.sparkSession if df is not None else None)
        self._df = df
        self._order: list[Key] = []  # none: the order in which the frame's plan gives its rows
        self._parts = 1
        self._indexes: dict[str, IndexSpec] = {}
        self._searches: dict[str, tuple[int, frozenset[str], DataFrame]] = {}
        self._version = 0
        self._row_class: Callable[..., Any] | None = None
        self.create_time = self.modify_time = dt.datetime.now()
        self.import_time: dt.datetime | None = None
        self.import_source: str | None = None
        self.import_source_type: str | None = None
        if df is not None and POS in df.columns:
            self._order = order.natural()

    # plumbing

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        return self._spark

    @property
    def df(self) -> DataFrame:
        """The frame behind the table; it may have hidden columns."""
        if self._df is None:
            self._df = self.spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in self._indexes]))
        return self._df

    @property
    def frame(self) -> DataFrame:
        """The visible columns; rows in no particular order."""
        return self.df.select(*[F.col(f"`{c}`") for c in self.columns])

    @property
    def sorted_frame(self) -> DataFrame:
        """The visible columns, sorted."""
        return self._sorted().select(*[F.col(f"`{c}`") for c in self.columns])

    @property
    def columns(self) -> list[str]:
        return order.visible(self.df)

    @property
    def has_order(self) -> bool:
        return bool(self._order) or POS in self.df.columns

    @staticmethod
    def _index_spec(unique: bool) -> IndexSpec:
        return IndexSpec(unique)

    def _set(self, df: DataFrame, keys: list[Key] | None = None) -> None:
        self._df = df
        if keys is not None:
            self._order = keys
        self._version += 1
        self.modify_time = dt.datetime.now()

    def _derived(self, df: DataFrame, keys: list[Key] | None = None, name: str | None = None) -> Table:
        out = Table(self.table_name if name is None else name, df, self.spark)
        out._order = self._order if keys is None else keys
        out._parts = self._parts
        out._row_class = self._row_class if set(self.columns) == set(out.columns) else None
        out._indexes = {k: IndexSpec(v.unique, v.accept_none) for k, v in self._indexes.items() if k in df.columns}
        return out

    def _ordered(self) -> tuple[DataFrame, list[Key]]:
        """The frame with what its order needs, and keys that decide between all rows."""
        if self._order and self._order[-1].name == POS or not self._order and POS in self.df.columns:
            return self.df, self._order or order.natural()
        if self._order and self._order[-1].name.startswith("_wf_") and POS not in self.df.columns:
            return self.df, self._order
        return order.positioned(self.df), [*self._order, *order.natural()]

    def _sorted(self) -> DataFrame:
        df, keys = self._ordered() if self._order else (self.df, order.natural() if POS in self.df.columns else [])
        return df.orderBy(*order.columns(keys)) if keys else df

    def _numbered(self) -> tuple[DataFrame, int]:
        df, keys = self._ordered()
        return order.numbered(df, keys), len(keys)

    def _first(self) -> Any:
        row = self.sorted_frame.first()
        return row if row is None else self._made(row)

    def _made(self, row: Row) -> Any:
        """The row as an object of the class that an import was given."""
        if self._row_class in (None, dict):
            return row
        return self._row_class(**{n: v for n, v in row.asDict().items() if not n.startswith("_wf_")})

    # sequence protocol

    def __len__(self) -> int:
        return self.df.count()

    def __bool__(self) -> bool:
        return not self.df.isEmpty()

    def __iter__(self) -> Iterator[Any]:
        return map(self._made, write.rows_of(self.sorted_frame))

    def __reversed__(self) -> Iterator[Any]:
        df, keys = self._ordered()
        return map(self._made, write.rows_of(df.orderBy(*order.columns([k.flipped() for k in keys])).select(*[F.col(f"`{c}`") for c in self.columns])))

    def __call__(self, table_name: str) -> Table:
        self.table_name = table_name
        return self

    def _match(self, item: Any) -> Column:
        values = as_dict(item)
        if not set(values) <= set(self.columns):
            return F.lit(False)
        out = F.lit(True)
        for c in self.columns:
            out = out & F.col(f"`{c}`").eqNullSafe(values.get(c))
        return out

    def __contains__(self, item: Any) -> bool:
        return not self.df.where(self._match(item)).isEmpty()

    def index(self, item: Any) -> int:
        df, _ = self._numbered()
        found = df.where(self._match(item)).agg(F.min(NUMBER)).first()[0]
        if found is None:
            raise ValueError("no such row")
        return found

    def count(self, item: Any) -> int:
        return self.df.where(self._match(item)).count()

    def _positions(self, key: slice) -> Column:
        start, stop, step = key.indices(len(self))
        n = F.col(NUMBER)
        if step > 0:
            return (n >= start) & (n < stop) & ((n - start) % step == 0)
        return (n <= start) & (n > stop) & ((F.lit(start) - n) % -step == 0)

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, slice):
            if key.start in (None, 0) and key.step in (None, 1) and key.stop is not None and key.stop >= 0:
                return self.head(key.stop)
            df, _ = self._numbered()
            out = self._derived(df.where(self._positions(key)).drop(NUMBER) if (key.step or 1) > 0 else df.where(self._positions(key)))
            if (key.step or 1) < 0:
                out._order = [Key(NUMBER, True)]
                out._df = out._df.drop(PART, POS).withColumns({PART: F.lit(0).cast("bigint"), POS: -F.col(NUMBER)}).drop(NUMBER)
                out._order = order.natural()
            elif not self._order and POS in df.columns:
                out._order = order.natural()
            return out
        if isinstance(key, str):
            return Values(self, key)
        near = self.head(key + 1) if key >= 0 else self.tail(-key)
        if len(near) < (key + 1 if key >= 0 else -key):
            raise IndexError(key)
        return next(reversed(near)) if key >= 0 else near._first()

    def __delitem__(self, key: Any) -> None:
        if not isinstance(key, slice):
            size = len(self)
            at = key + size if key < 0 else key
            if not 0 <= at < size:
                raise IndexError(key)
            key = slice(at, at + 1)
        df, _ = self._numbered()
        self._set(df.where(~self._positions(key)).drop(NUMBER), self._order or order.natural())

    def pop(self, i: int = -1) -> Row:
        row = self[i]
        del self[i]
        return row

    # rows in and out

    def insert(self, row: Any) -> Table:
        return self.insert_many([row])

    def insert_many(self, rows: Iterable[Any]) -> Table:
        """Appends rows; unique indexes are checked before anything is inserted."""
        if isinstance(rows, Table):
            return self._append(rows)
        dicts = [as_dict(r) for r in rows]
        if not dicts:
            return self
        schema = self.df.schema if self._df is not None else None
        known = T.StructType([f for f in schema.fields if not f.name.startswith("_wf_") and self.columns]) if schema is not None else None
        try:
            new = read.frame_of(self.spark, dicts, known)
        except Exception:  # values of other types than the columns have  # noqa: BLE001
            new = read.frame_of(self.spark, dicts)
        return self._append(Table(df=new))

    def _append(self, other: Table) -> Table:
        right, _ = other._ordered()
        if other._order and other._order[0].name not in (PART, POS):
            right = order.numbered(*other._ordered()).withColumns({PART: F.lit(0).cast("bigint"), POS: F.col(NUMBER)}).drop(NUMBER)
        for name, spec in self._indexes.items():
            if spec.unique:
                self._check_unique(name, spec, right)
        right = right.withColumn(PART, F.col(PART) + self._parts)
        if self._df is None or not self.columns:
            self._set(right, order.natural())
        else:
            left, keys = self._ordered()
            if keys[0].name != PART:
                left = order.numbered(left, keys).withColumns({PART: F.lit(0).cast("bigint"), POS: F.col(NUMBER)}).drop(NUMBER)
            extra = [c for c in left.columns if c.startswith("_wf_") and c not in (PART, POS)]
            kinds = dict(left.dtypes)
            same = [F.col(f"`{c}`") if kinds.get(c, k) == k or {kinds[c], k} <= {"bigint", "double", "int"} else F.col(f"`{c}`").cast(kinds[c]).alias(c) for c, k in right.dtypes if not c.startswith("_wf_") or c in (PART, POS)]
            self._set(left.drop(*extra).unionByName(right.select(*same), allowMissingColumns=True), order.natural())
        self._parts += other._parts + 1
        return self

    def _check_unique(self, name: str, spec: IndexSpec, more: DataFrame | None = None) -> None:
        rows = self.df.select(F.col(f"`{name}`").alias("k")) if name in self.df.columns else None
        if more is not None and name in more.columns:
            rows = more.select(F.col(f"`{name}`").alias("k")) if rows is None else rows.union(more.select(F.col(f"`{name}`").alias("k")))
        if rows is None:
            return
        bad = rows.groupBy("k").count().where(F.col("count") > 1 if spec.accept_none else (F.col("count") > 1) | F.col("k").isNull()).first()
        if bad is not None:
            raise KeyError(f"key {bad['k']!r} can't be in unique index {name!r}")

    def remove(self, row: Any) -> Table:
        return self.remove_many([row])

    def remove_many(self, rows: Iterable[Any]) -> Table:
        """Each of rows removes the first row that equals it and isn't removed yet."""
        names = self.columns
        wanted = rows.frame if isinstance(rows, Table) else None
        if wanted is None:
            dicts = [d for d in (as_dict(r) for r in rows) if set(d) <= set(names)]
            if not dicts:
                return self
            data = T.StructType([self.df.schema[n] for n in names])
            wanted = self.spark.createDataFrame([tuple(read._plain(d.get(n)) for n in names) for d in dicts], data)
        counts = wanted.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count("*").alias("_wf_gone")).select(*[F.col(f"`{n}`").alias(f"_wf_x{i}") for i, n in enumerate(names)], "_wf_gone")
        df, keys = self._ordered()
        df = order.positioned(df)
        joined = df.join(counts, [F.col(f"`{n}`").eqNullSafe(F.col(f"_wf_x{i}")) for i, n in enumerate(names)], "left").drop(*[f"_wf_x{i}" for i in range(len(names))])
        # only rows that equal a wanted one are numbered
        nth = F.row_number().over(order.Window.partitionBy(*[F.col(f"`{n}`") for n in names]).orderBy(*order.columns(keys)))
        equal = joined.where("_wf_gone is not null").withColumn("_wf_nth", nth).where("_wf_nth > _wf_gone").drop("_wf_nth")
        self._set(joined.where("_wf_gone is null").union(equal).drop("_wf_gone"), keys)
        return self

    def delete(self, wherefn: Any = None, **kwargs: Any) -> int:
        """Removes the rows that where() would select; how many there were. Nothing without a condition."""
        if wherefn is None and not kwargs:
            return 0
        test = F.coalesce(self._predicate(wherefn, kwargs), F.lit(False))
        gone = self.df.where(test).count()
        self._set(self.df.where(~test))
        return gone

    def clear(self) -> Table:
        self._searches = {}
        self._set(self.df.limit(0))
        return self

    def compute_field(self, name: str, fn: Any, default: Any = None, returns: T.DataType | str | None = None) -> Table:
        """Adds or replaces a field: a column's name, a Column, a constant, or a function of the row; default where the function fails."""
        df = self.df
        if isinstance(fn, Column):
            c = fn
        elif isinstance(fn, str):
            c = F.col(f"`{fn}`")
        elif callable(fn):
            c = record.row_column(df, fn, returns, "default", default)
        else:
            c = F.lit(fn)
        searches, version = self._searches, self._version
        self._set(df.withColumn(name, c))
        self._searches = {k: (self._version if v[0] == version else v[0], *v[1:]) for k, v in searches.items()}
        return self

    add_field = compute_field

    def shuffle(self, seed: int | None = None) -> Table:
        df, _ = self._ordered()
        held = df.drop(PART, POS).withColumns({PART: F.lit(0).cast("bigint"), POS: F.floor(F.rand(seed) * float(1 << 62)).cast("bigint")})
        self._set(order.stash(held, "shuffled"), order.natural())
        return self

    def clone(self, name: str | None = None) -> Table:
        return self._derived(self.df, name=name)

    def copy_template(self, name: str | None = None) -> Table:
        return self._derived(self.df.limit(0), name=name)

    # indexes

    def create_index(self, attr: str, unique: bool = False, accept_none: bool = False, force: bool = False) -> Table:
        """Names a field as a key. A unique index is a constraint, checked here and when rows are inserted."""
        if attr in self._indexes and not force:
            raise ValueError(f"index {attr!r} exists")
        if attr in self.df.columns and isinstance(self.df.schema[attr].dataType, (T.ArrayType, T.MapType)):
            raise TypeError(f"values of {attr!r} can't be keys")
        spec = IndexSpec(unique, accept_none)
        if unique:
            self._check_unique(attr, spec)
        self._indexes[attr] = spec
        return self

    def drop_index(self, attr: str) -> Table:
        self._indexes.pop(attr, None)
        return self

    delete_index = drop_index

    def get_index(self, attr: str) -> Index:
        return self._index(attr)

    def _index(self, attr: str) -> Index:
        if attr not in self._indexes:
            raise AttributeError(f"no index {attr!r}")
        return Index(self, attr, self._indexes[attr])

    @property
    def by(self) -> Accessor:
        return Accessor(self._index, lambda: list(self._indexes))

    @property
    def all(self) -> Accessor:
        return Accessor(lambda n: Values(self, n), lambda: self.columns)

    # rows and columns

    def _predicate(self, wherefn: Any, kwargs: dict[str, Any]) -> Column:
        test, names = F.lit(True), self.columns
        for name, value in kwargs.items():
            if name in names:
                test = test & predicates.value_test(value, F.col(f"`{name}`"))
            elif not callable(value):
                test = F.lit(False)
            elif isinstance(value, predicates.Predicate) and value.name not in ("is_null()", "is_not_null()"):
                if names:
                    raise AttributeError(f"no field {name!r}")
                test = F.lit(False)
            else:
                test = test & predicates.value_test(value, F.lit(None))
        if isinstance(wherefn, Column):
            test = test & wherefn
        elif wherefn is not None:
            test = test & record.row_column(self.df, wherefn, T.BooleanType() if _gives_bool(self, wherefn) else None).cast("boolean")
        return test

    def where(self, wherefn: Any = None, **kwargs: Any) -> Table:
        """Rows for which all conditions hold: field=value, field=comparator, field=function, and a function of the row.

        A comparator over a field that the table lacks raises AttributeError, but for is_null and is_not_null; no row equals a value there.
        """
        return self._derived(self.df.where(self._predicate(wherefn, kwargs)))

    def select(self, fields: str | Iterable[str] | None = None, **exprs: Any) -> Table:
        """Fields by the field mini-language, and computed ones: Columns, functions of the row, templates."""
        names = parse_fields(fields, self.columns) if fields is not None or not exprs else []
        made = {}
        for name, e in exprs.items():
            made[name] = e if isinstance(e, Column) else record.template(self.df, e) if isinstance(e, str) else record.row_column(self.df, e, errors="default")
        cols = [(F.col(f"`{n}`") if n in self.columns else F.lit(None).cast("string").alias(n)) for n in names if n not in made]
        hidden = [k.name for k in self._order if k.name not in names or k.name in made]
        out, keys = self.df, list(self._order)
        renamed = {n: f"_wf_by_{n}" for n in hidden if not n.startswith("_wf_")}
        keep = [F.col(f"`{n}`").alias(a) for n, a in renamed.items()] + [F.col(c) for c in out.columns if c.startswith("_wf_")]
        out = out.select(*cols, *[c.alias(n) for n, c in made.items()], *keep)
        return self._derived(out, [Key(renamed.get(k.name, k.name), k.descending) for k in keys])

    def formatted_table(self, *fields: str, **exprs: Any) -> Table:
        """All texts; a null shows as None."""
        out = self.select(" ".join(fields) or (None if exprs else "*"), **exprs)
        return out._derived(out.df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in out.columns}))

    def format(self, text: str) -> Iterator[str]:
        for row in self:
            yield text.format(row, **row.asDict())

    def namedtuple_from_fields(self, name: str = "") -> type:
        return namedtuple(name or self.table_name or "Row", self.columns)

    def orderby(self, key: Any, reverse: bool = False) -> Table:
        """Sorts in place, stably. Nulls come last, first where descending."""
        df = self.df
        if callable(key):
            df = df.withColumn("_wf_key", record.row_column(df.drop("_wf_key"), key))
            keys = [Key("_wf_key", reverse)]
        else:
            keys = parse_sort(key, reverse)
        names = {k.name for k in keys}
        self._df = df
        self._order = [*keys, *[k for k in self._order if k.name not in names]]
        self._version += 1
        return self

    sort = orderby

    def rank(self, rank_col_name: str = "rank", start: int = 1) -> Table:
        """Numbers the rows in their order; ties get numbers of their own."""
        df, keys = self._ordered()
        self._set(order.numbered(df, keys).withColumn(rank_col_name, F.col(NUMBER) + start).drop(NUMBER), [Key(rank_col_name)])
        return self

    def head(self, n: int = 10) -> Table:
        df, keys = self._ordered()
        return self._derived(df.orderBy(*order.columns(keys)).limit(max(0, n)), keys)

    def tail(self, n: int = 10) -> Table:
        df, keys = self._ordered()
        return self._derived(df.orderBy(*order.columns([k.flipped() for k in keys])).limit(max(0, n)), keys)

    def batched(self, n: int) -> Iterator[Table]:
        if n <= 0:
            raise ValueError("batches need rows")
        df, _ = self._numbered()
        size = df.count()
        for at in range(0, size, n):
            yield self._derived(df.where((F.col(NUMBER) >= at) & (F.col(NUMBER) < at + n)).drop(NUMBER))

    def batch_ids(self, n: int, name: str = "batch") -> Table:
        """All batches at once: the table with each row's batch number."""
        if n <= 0:
            raise ValueError("batches need rows")
        df, keys = self._ordered()
        return self._derived(order.numbered(df, keys).withColumn(name, F.floor(F.col(NUMBER) / n).cast("bigint")).drop(NUMBER), keys)

    def unique(self, key: Any = None) -> Table:
        """Of rows with equal keys, or equal rows, the first stays."""
        df, keys = self._ordered()
        if key is None:
            by = [F.col(f"`{c}`") for c in self.columns]
        elif callable(key):
            by = [record.row_column(self.df, key)]
        else:
            by = [F.col(f"`{k}`") for k in ([key] if isinstance(key, str) else key)]
        first = F.row_number().over(order.Window.partitionBy(*by).orderBy(*order.columns(keys)))
        return self._derived(df.withColumn("_wf_nth", first).where("_wf_nth = 1").drop("_wf_nth"), keys)

    def splitby(self, pred: Any = None, *, errors: Any = "discard", **kwargs: Any) -> tuple[Table, ...]:
        """(rows where it doesn't hold, rows where it does); with errors='return' also the rows where it fails. errors: False, True, 'discard', 'return', 'raise', or a
        dict of these by exception.
        """
        policies = set(errors.values()) if isinstance(errors, dict) else {errors}
        if not policies <= {True, False, "discard", "return", "raise"}:
            raise ValueError(f"unknown error policy {errors!r}")
        if pred is None:
            code = F.when(self._predicate(None, kwargs), 1).otherwise(0)
        elif isinstance(pred, str):
            truth = F.col(f"`{pred}`")
            code = F.when(F.coalesce(truth.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), 0).otherwise(1)
        else:
            code = self._split_code(pred, errors)
        df = self.df.withColumn("_wf_side", code)
        side = lambda n: self._derived(df.where(F.col("_wf_side") == n).drop("_wf_side"))
        return (side(0), side(1), side(2)) if "return" in policies else (side(0), side(1))

    def _split_code(self, pred: Callable[[Any], Any], errors: Any) -> Column:
        try:
            native = pred(record.Record(self.df))
        except Exception:  # it needs real rows  # noqa: BLE001
            native = None
        if isinstance(native, Column):
            return F.when(F.coalesce(native.cast("boolean"), F.lit(False)), 1).otherwise(0)
        names = self.columns

        def run(row: Row) -> int:
            try:
                return int(bool(pred(record.namespace(row))))
            except Exception as e:  # what to do is the caller's choice
                policy = next((p for kind, p in errors.items() if isinstance(e, kind)), "raise") if isinstance(errors, dict) else errors
                if policy == "raise":
                    raise
                return 2 if policy == "return" else 3 if policy == "discard" else int(policy)

        return F.udf(run, T.IntegerType())(F.struct(*[F.col(f"`{n}`") for n in names]))

    # joins and unions

    def union(self, other: Any) -> Table:
        return self.clone().insert_many(other)

    def __add__(self, other: Any) -> Any:
        if isinstance(other, joins.JoinTerm):
            return other.__radd__(self)
        return self.union(other)

    def __iadd__(self, other: Any) -> Table:
        return self.insert_many(other)

    def _joined(self, other: Table, attrlist: Any, keys: dict[str, str], kind: str, mark: str, grid: bool, auto: bool) -> Table:
        on = joins.pairs_of(self, other, keys)
        if not auto:
            for t, i in ((self, 0), (other, 1)):
                if any(k[i] not in t._indexes for k in on):
                    raise ValueError("a field of the join has no index")
        wanted = joins.outputs(self, other, attrlist)
        df, order_keys = joins.join_frames(self, other, on, wanted, kind, grid)
        name = f"({self.table_name}:{'/'.join(a for a, _ in on)}{mark}{other.table_name}:{'/'.join(b for _, b in on)})"
        out = Table(name, df, self.spark)
        out._order = order_keys
        out._indexes = {alias: IndexSpec() for side, c, alias in wanted if c in (self if side == "l" else other)._indexes}
        return out

    def join(self, other: Table, attrlist: Any = None, auto_create_indexes: bool = True, **keys: str) -> Table:
        """Inner join on left='right' fields; a name that both sides have is the left side's."""
        return self._joined(other, attrlist, keys, "inner", "^", True, auto_create_indexes)

    def outer_join(self, join_type: str, other: Table, attrlist: Any = None, auto_create_indexes: bool = True, compat: bool = True, how: str | None = None, **keys: str) -> Table:
        """RIGHT_OUTER_JOIN keeps all rows of this table, LEFT_OUTER_JOIN all of the other, FULL_OUTER_JOIN both; `how` takes SQL's names instead.

        Rows with null keys are dropped. With compat a full join on several fields covers the product of the fields' values, else only rows that exist.
        """
        kind = {"left": "keep_self", "right": "keep_other", "full": "full"}.get(how or "") or joins.KINDS.get(join_type)
        if kind is None:
            raise ValueError(f"join type must be one of {', '.join(self.OUTER_JOIN_TYPES)}")
        if other is self:
            return self.clone()
        return self._joined(other, attrlist, keys, kind, "|", compat, auto_create_indexes)

    def join_on(self, attr: str, join: str = "inner") -> joins.JoinTerm:
        if attr not in self._indexes:
            raise ValueError(f"no index {attr!r} to join on")
        return joins.JoinTerm(self, attr, join)

    def anti_join(self, other: Table, **keys: str) -> Table:
        """Rows without a partner, as the outer join and where(field=None) idiom gives them."""
        on = joins.pairs_of(self, other, keys)
        right = other.df.select(*[F.col(f"`{b}`").alias(f"_wf_k{i}") for i, (_, b) in enumerate(on)])
        left = self.df.where(" and ".join(f"`{a}` is not null" for a, _ in on))
        return self._derived(left.join(right, [F.col(f"`{a}`") == F.col(f"_wf_k{i}") for i, (a, _) in enumerate(on)], "left_anti"))

    # summaries

    def groupby_with_summaries(self, keyexpr: Any, types: dict[str, Any] | None = None, **outexprs: Any) -> Table:
        """A row for each key, sorted by key. An output is len, a Column, (function, field), or a function of the group's rows."""
        df = self.df
        if isinstance(keyexpr, str):
            keys = keyexpr.split()
        elif isinstance(keyexpr, tuple) and len(keyexpr) == 2 and callable(keyexpr[1]):
            keys = [keyexpr[0]]
            df = df.withColumn(keyexpr[0], record.row_column(df, keyexpr[1]))
        else:
            raise TypeError("a key is field names or (name, function)")
        out = self._derived(grouping.summarized(df, keys, outexprs, types), [])
        out._indexes = {k: IndexSpec(unique=len(keys) == 1, accept_none=True) for k in keys}
        return out.orderby(",".join(keys))

    def _key_columns(self, key: Any) -> list[Column]:
        if isinstance(key, str):
            return [F.col(f"`{key}`")]
        if callable(key):
            return [record.row_column(self.df, key)]
        return [F.col(f"`{k}`") for k in key]

    def run_ids(self, key: Any, name: str = "run", partition: list[str] | None = None) -> Table:
        """With the number of the row that begins each row's run of consecutive equal keys."""
        df, keys = self._ordered()
        out = order.runs(df, self._key_columns(key), keys, "_wf_run", partition)
        return self._derived(out.withColumnRenamed("_wf_run", name), keys)

    def groupby(self, key: Any, sort: bool = False) -> Iterator[tuple[Any, Table]]:
        """(key, rows) for each run of consecutive equal keys; for each key if sorted first."""
        cols = self._key_columns(key)
        single = isinstance(key, str) or callable(key)
        df, keys = self._ordered()
        named = df.withColumns({f"_wf_g{i}": c for i, c in enumerate(cols)})
        if sort:
            groups = named.select(*[f"_wf_g{i}" for i in range(len(cols))]).distinct().orderBy(*[f"_wf_g{i}" for i in range(len(cols))])
            for row in groups.toLocalIterator():
                test = F.lit(True)
                for i, v in enumerate(row):
                    test = test & F.col(f"_wf_g{i}").eqNullSafe(v)
                yield (row[0] if single else tuple(row)), self._derived(named.where(test).drop(*[f"_wf_g{i}" for i in range(len(cols))]), keys)
            return
        runs = order.stash(order.runs(named, [F.col(f"_wf_g{i}") for i in range(len(cols))], keys), "runs")
        heads = runs.groupBy("_wf_run").agg(*[F.first(f"_wf_g{i}").alias(f"g{i}") for i in range(len(cols))]).orderBy("_wf_run")
        for row in heads.toLocalIterator():
            values = tuple(row)[1:]
            rows = runs.where(F.col("_wf_run") == row[0]).drop("_wf_run", *[f"_wf_g{i}" for i in range(len(cols))])
            yield (values[0] if single else values), self._derived(rows, keys)

    def stats(self, field_names: Any = None, by_field: bool = True, rounded: bool = True) -> Table:
        """Statistics of the numeric fields: a row a field, or, transposed, a row a statistic."""
        names = stats.numeric(self.df, parse_fields(field_names, self.columns))
        out = self._derived(stats.by_field(self.df, names, rounded) if by_field else stats.by_statistic(self.df, names, rounded), [])
        out._indexes = {"name" if by_field else "stat": IndexSpec(unique=True)}
        return out

    def pivot(self, fields: Any) -> pivot.Pivot:
        names = fields.split() if isinstance(fields, str) else list(fields)
        if not 1 <= len(names) <= 3 or any(n not in self._indexes for n in names):
            raise ValueError("a pivot is over one to three fields with indexes")
        return pivot.Pivot(self, names)

    def info(self) -> dict[str, Any]:
        return {
            "len": len(self),
            "name": self.table_name,
            "fields": self.columns,
            "indexes": [(k, v.unique) for k, v in self._indexes.items()],
            "created": self.create_time,
            "modified": self.modify_time,
            "last_import": self.import_time,
        }

    # search

    def create_search_index(self, attr: str, *, using: Any = None, stopwords: Iterable[str] | None = None, force: bool = False) -> Table:
        """Keeps each row's word forms for search; `using` first makes the field from others."""
        if attr in self._searches and not force and self._searches[attr][0] == self._version:
            return self
        if using is not None:
            names = parse_fields(using, self.columns)
            self.compute_field(attr, F.concat_ws(" ", *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names]))
        stop = search.stopwords_of(stopwords)
        df, keys = self._ordered()
        self._df, self._order = df, self._order or keys
        self._searches[attr] = (self._version, stop, order.stash(search.indexed(df, attr, stop), "words", batch=(search.ROWS, search.BATCH)))
        return self

    def delete_search_index(self, attr: str) -> Table:
        self._searches.pop(attr, None)
        return self

    def rebuild_search_index(self, attr: str, force: bool = True) -> Table:
        if attr not in self._searches:
            raise NoSuchIndexError(attr)
        return self.create_search_index(attr, stopwords=self._searches[attr][1], force=force)

    @property
    def search(self) -> Accessor:
        return Accessor(lambda attr: lambda query, **kw: self._search(attr, query, **kw), lambda: list(self._searches))

    def _search(self, attr: str, query: Any, limit: int | None = None, min_score: int | None = 0, include_words: bool = False, as_table: bool = True) -> Any:
        """Rows by score, then by the first of the query's terms they have, then in order. The limit comes before the least score."""
        if attr not in self._searches:
            raise ValueError(f"no search index on {attr!r}")
        version, stop, tokens = self._searches[attr]
        if version != self._version:
            raise SearchIndexInconsistentError(f"table changed since the search index on {attr!r} was built")
        score, listed = f"{attr}_search_score", f"{attr}_search_words"
        _, keys = self._ordered()
        out = search.search(tokens, search.parse(query, stop), keys, score, listed if include_words else None, limit, min_score)
        found = self._derived(out, [Key(score, True), Key("_wf_first"), *keys])
        if as_table:
            return found
        extra = [score, *([listed] if include_words else [])]
        names = [c for c in found.columns if c not in extra]
        return [(record.namespace(Row(**{n: r[n] for n in names})), *(r[e] for e in extra)) for r in found]

    # import and export

    def _import(self, df: DataFrame, source: Any, transforms: Any, filters: Any, limit: int | None, row_class: Callable[..., Any] | None = None) -> Table:
        """row_class makes the rows' objects wherever rows come to the driver; it takes the fields by name."""
        df = read.shaped(df, transforms, filters, limit)
        self._row_class = row_class or self._row_class
        self._append(Table(df=df))
        kind = fetch.kind_of(source)
        self.import_source_type = kind
        self.import_source = str(source) if kind not in ("string", "iterable") else None
        self.import_time = dt.datetime.now()
        return self

    def csv_import(self, csv_source: Any, encoding: str = "utf-8", transforms: Any = None, filters: Any = None, row_class: Any = None, limit: int | None = None, fieldnames: Any = None, **kwargs: Any) -> Table:
        return self._import(read.delimited(self.spark, csv_source, encoding, kwargs.pop("delimiter", ","), fieldnames, **kwargs), csv_source, transforms, filters, limit, row_class)

    def tsv_import(self, xsv_source: Any, encoding: str = "utf-8", transforms: Any = None, filters: Any = None, row_class: Any = None, limit: int | None = None, fieldnames: Any = None, **kwargs: Any) -> Table:
        return self._import(read.delimited(self.spark, xsv_source, encoding, "\t", fieldnames, **kwargs), xsv_source, transforms, filters, limit, row_class)

    def json_import(self, source: Any, encoding: str = "utf-8", transforms: Any = None, row_class: Any = None, streaming: bool = False, path: str = "", json_decoder: Any = None, limit: int | None = None, **kwargs: Any) -> Table:
        return self._import(read.json_rows(self.spark, source, encoding, streaming, path, json_decoder, **kwargs), source, transforms, None, limit, row_class)

    def excel_import(self, excel_source: Any, transforms: Any = None, filters: Any = None, row_class: Any = None, limit: int | None = None, fieldnames: Any = None, sheet: str | None = None) -> Table:
        return self._import(read.excel_rows(self.spark, excel_source, sheet, fieldnames), excel_source, transforms, filters, limit, row_class)

    def parquet_import(self, path: str, filters: Any = None) -> Table:
        return self._import(self.spark.read.parquet(path), path, None, filters, None)

    def _export(self, fieldnames: Any) -> DataFrame:
        names = parse_fields(fieldnames, self.columns)
        return self._sorted().select(*[F.col(f"`{n}`") if n in self.columns else F.lit(None).cast("string").alias(n) for n in names])

    def csv_export(self, csv_dest: Any = None, fieldnames: Any = None, encoding: str = "utf-8", delimiter: str = ",", **kwargs: Any) -> str | None:
        return write.delimited(self._export(fieldnames), csv_dest, encoding, delimiter, **kwargs)

    def tsv_export(self, tsv_dest: Any = None, fieldnames: Any = None, encoding: str = "utf-8", **kwargs: Any) -> str | None:
        return write.delimited(self._export(fieldnames), tsv_dest, encoding, "\t", **kwargs)

    def json_export(self, dest: Any = None, fieldnames: Any = None, encoding: str = "utf-8", streaming: bool = False, json_encoder: Any = None) -> str | None:
        lines = streaming or (dest is not None and str(dest).endswith(".jsonl"))
        return write.json_text(self._export(fieldnames), dest, encoding, lines, json_encoder)

    def excel_export(self, excel_dest: Any, fieldnames: Any = None) -> None:
        write.excel(self._export(fieldnames), excel_dest)

    def folder_export(self, path: str, kind: str = "parquet", fieldnames: Any = None, **options: Any) -> None:
        """For large tables: written by the tasks, one file each."""
        write.folder(self._export(fieldnames), path, kind, **options)

    def as_dataframe(self, fields: Any = None) -> Any:
        return self._export(fields).toPandas()

    def _cells(self, fields: Any) -> tuple[list[str], list[list[Any]]]:
        df = self._export(fields)
        return df.columns, [list(r) for r in df.toLocalIterator()]

    def as_html(self, fields: Any = "*", formats: Any = None, groupby: Any = None, table_properties: Any = None) -> str:
        return render.html(*self._cells(fields), formats, _group(groupby), table_properties)

    def as_markdown(self, fields: Any = "*", formats: Any = None, groupby: Any = None) -> str:
        return render.markdown(*self._cells(fields), formats, _group(groupby))

    def present(self, fields: Any = None, file: Any = None, groupby: Any = None, width: int | None = None, title: str | None = None, caption: str | None = None, show_header: bool = True, show_lines: bool = False) -> None:
        """Prints the table, by default under its name."""
        text = render.plain(*self._cells(fields), _group(groupby), width, self.table_name if title is None else title, caption, show_header, show_lines)
        (file or sys.stdout).write(text)


def _group(groupby: Any) -> list[str] | None:
    return groupby.split() if isinstance(groupby, str) else list(groupby) if groupby else None


def _gives_bool(table: Table, fn: Callable[[Any], Any]) -> bool:
    """Whether the test has to run row by row, where its result counts as a truth value."""
    try:
        return not isinstance(fn(record.Record(table.df)), Column)
    except Exception:  # it needs real rows  # noqa: BLE001
        return True


def csv_import(*args: Any, **kwargs: Any) -> Table:
    return Table().csv_import(*args, **kwargs)


def tsv_import(*args: Any, **kwargs: Any) -> Table:
    return Table().tsv_import(*args, **kwargs)


def json_import(*args: Any, **kwargs: Any) -> Table:
    return Table().json_import(*args, **kwargs)


def excel_import(*args: Any, **kwargs: Any) -> Table:
    return Table().excel_import(*args, **kwargs)


Sequence.register(Table)

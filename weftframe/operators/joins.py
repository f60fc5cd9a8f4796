"""Equi-joins between tables, and join terms that are composed with +."""

from __future__ import annotations

import math
import re
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import PART, POS, Key, positioned, visible
from ..plans.scratch import product, stash

if TYPE_CHECKING:
    from ..table import Table

#: Rows that a key needs on either side before its pairs are counted, pairs beyond which a key is dealt to several tasks, and bytes of a side that is too small for such keys.
MANY, PAIRS, LITTLE = 256, 1 << 20, 4096

KINDS = {"right outer join": "keep_self", "left outer join": "keep_other", "full outer join": "full"}


def pairs_of(left: Table, right: Table, keys: dict[str, str]) -> list[tuple[str, str]]:
    if not keys:
        raise TypeError("a join needs one pair of fields at least, as left='right'")
    for a, b in keys.items():
        if not isinstance(a, str) or not isinstance(b, str):
            raise TypeError("join fields are given by name")
        if a not in left.columns and left.columns:
            raise ValueError(f"no field {a!r} in the left table")
        if b not in right.columns and right.columns:
            raise ValueError(f"no field {b!r} in the right table")
    return list(keys.items())


def outputs(left: Table, right: Table, attrs: Any) -> list[tuple[str, str, str]]:
    """(side, column, alias): the left table's columns win where names clash."""
    if attrs is None:
        wanted: list[tuple[str, str, str]] = [("l", c, c) for c in left.columns] + [("r", c, c) for c in right.columns]
    else:
        wanted = []
        for item in [a for a in re.split(r"[,\s]+", attrs) if a] if isinstance(attrs, str) else attrs:
            if isinstance(item, str):
                side = "l" if item in left.columns else "r" if item in right.columns else None
                name = alias = item
            else:
                table, name = item[0], item[1]
                alias = item[2] if len(item) > 2 else name
                side = "l" if table is left and name in left.columns else "r" if table is right and name in right.columns else None
            if side is None:
                raise ValueError(f"no field {name!r} to join")
            wanted.append((side, name, alias))
    seen: set[str] = set()
    return [w for w in wanted if not (w[2] in seen or seen.add(w[2]))]


def _sides(left: Table, right: Table) -> tuple[DataFrame, DataFrame]:
    def named(t: Table, mark: str) -> DataFrame:
        df = positioned(t.df) if t.has_order else t.df
        return df.select(*[F.col(f"`{c}`").alias(f"{mark}_{c}") for c in df.columns if not c.startswith("_wf_") or c in (PART, POS)])

    return named(left, "l"), named(right, "r")


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _dealt(l: DataFrame, r: DataFrame, on: list[tuple[str, str]], kind: str) -> tuple[DataFrame, DataFrame] | None:  # noqa: E741
    """The sides with a share, also to be joined on, for keys of more than PAIRS pairs: one side's rows have one of the key's shares by their content, the other's
    have all of them. None where no key has so many, which a count of the smaller side's keys tells as a rule.
    """
    if l.isStreaming or r.isStreaming or any(l.schema[a].dataType != r.schema[b].dataType for a, b in on):
        return None
    sides, sizes = (l, r), (_bytes(l), _bytes(r))
    if min(sizes) < LITTLE:
        return None
    counts = [df.groupBy(*[F.col(f"`{k[i]}`") for k in on]).agg(F.count("*").alias(f"_wf_n{i}")).where(f"_wf_n{i} >= {MANY}") for i, df in enumerate(sides)]
    if counts[sizes.index(min(sizes))].isEmpty():
        return None
    pairs = F.col("_wf_n0") * F.col("_wf_n1").cast("double")
    heavy = stash(counts[0].join(counts[1], [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in on]).where(pairs > PAIRS), "heavy")
    most = heavy.agg(F.sum("_wf_n0"), F.sum("_wf_n1"), F.sum(pairs)).first()
    if most[2] is None:
        return None
    # the side that an outer join keeps whole has each row once; no more shares than leave a 16th of the pairs for copies
    split = {"keep_self": 0, "keep_other": 1}.get(kind, int(most[1] > most[0]))
    shares = F.greatest(F.lit(1), F.least(F.ceil(pairs / PAIRS), F.floor(F.col(f"_wf_n{split}") / 16))).cast("int")
    groups, least = math.ceil(most[2] / PAIRS), int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(10_000, max(least, groups // 4, min(groups, 4 * least)))  # hashes spread few groups unevenly
    out = []
    for i, df in enumerate(sides):
        keys = [k[i] for k in on]
        shared = heavy.select(*[F.col(f"`{k}`").alias(f"_wf_h{j}") for j, k in enumerate(keys)], shares.alias("_wf_shares"))
        df = df.join(shared, [F.col(f"`{k}`") == F.col(f"_wf_h{j}") for j, k in enumerate(keys)], "left")
        n = F.coalesce("_wf_shares", F.lit(1))
        content = [F.col(f"`{c}`") for c, kind_ in sides[i].dtypes if "map<" not in kind_ and "variant" not in kind_]
        share = F.pmod(F.xxhash64(*content), n).cast("int") if i == split else F.explode(F.sequence(F.lit(0), n - 1))
        df = df.withColumn(f"_wf_share{i}", share).drop("_wf_shares", *[f"_wf_h{j}" for j in range(len(keys))])
        out.append(df.repartition(tasks, *[F.col(f"`{k}`") for k in keys], f"_wf_share{i}"))
    return out[0], out[1]


def join_frames(left: Table, right: Table, keys: list[tuple[str, str]], wanted: list[tuple[str, str, str]], kind: str, grid: bool = True) -> tuple[DataFrame, list[Key]]:
    """The joined frame and its order. kind: inner, keep_self, keep_other or full. Null keys never match, and a row with one is not preserved. With grid, a
    full join on several fields goes over the product of the values that each field has on either side.
    """
    l, r = _sides(left, right)  # noqa: E741
    on = [(f"l_{a}", f"r_{b}") for a, b in keys]
    not_null = lambda df, i: df.where(" and ".join(f"`{k[i]}` is not null" for k in on))
    condition = [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in on]
    if kind != "full" and (dealt := _dealt(l, r, on, kind)):
        l, r = dealt  # noqa: E741
        condition.append(F.col("_wf_share0") == F.col("_wf_share1"))
    if kind == "inner":
        out = l.join(r, condition, "inner")
    elif kind == "keep_self":
        out = not_null(l, 0).join(r, condition, "left")
    elif kind == "keep_other":
        out = l.join(not_null(r, 1), condition, "right")
    elif len(on) == 1 or not grid:
        out = not_null(l, 0).join(not_null(r, 1), condition, "full")
    else:
        values = lambda i, a, b: l.select(F.col(f"`{a}`").alias(f"_wf_g{i}")).union(r.select(F.col(f"`{b}`"))).where(f"_wf_g{i} is not null").distinct()
        out = product([values(i, a, b) for i, (a, b) in enumerate(on)]).join(l, [F.col(f"_wf_g{i}") == F.col(f"`{a}`") for i, (a, _) in enumerate(on)], "left")
        out = out.join(r, [F.col(f"_wf_g{i}") == F.col(f"`{b}`") for i, (_, b) in enumerate(on)], "left")
        for i, (a, b) in enumerate(on):
            out = out.withColumns({a: F.col(f"_wf_g{i}"), b: F.col(f"_wf_g{i}")})
    if kind != "inner" and not (kind == "full" and len(on) > 1 and grid):
        for a, b in on:  # a padded row carries the key on both sides
            key = F.coalesce(F.col(f"`{a}`"), F.col(f"`{b}`"))
            out = out.withColumns({a: key, b: key})
    kept = [F.col(f"`{side}_{c}`").alias(alias) for side, c, alias in wanted]
    order = []
    for mark in "lr":
        if f"{mark}_{POS}" in out.columns:
            kept += [F.col(f"{mark}_{PART}").alias(f"_wf_{mark}part"), F.col(f"{mark}_{POS}").alias(f"_wf_{mark}pos")]
            order += [Key(f"_wf_{mark}part"), Key(f"_wf_{mark}pos")]
    return out.select(*kept), order if len(order) == 4 else []


class JoinTerm:
    """A table and the field that it is to be joined on; terms and tables are added up and joined when called."""

    def __init__(self, table: Table, field: str, kind: str = "inner"):
        self.table, self.field, self.kind = table, field, kind
        self.other: JoinTerm | None = None

    def _done(self) -> Table:
        return self() if self.other else self.table

    def __add__(self, other: Any) -> JoinTerm:
        if not isinstance(other, JoinTerm):
            other = other.join_on(self.field)
        if self.other is None and other.other is None:
            out = JoinTerm(self.table, self.field, self.kind)
            out.other = other
            return out
        left, right = self._done(), other._done()
        if self.field not in left.columns or other.field not in right.columns:
            raise ValueError("joined terms have lost the field to go on with; use join_on()")
        out = JoinTerm(left, self.field, self.kind)
        out.other = JoinTerm(right, other.field, other.kind)
        return out

    def __radd__(self, table: Any) -> JoinTerm:
        return self + table

    def join_on(self, field: str, join: str = "inner") -> JoinTerm:
        return JoinTerm(self._done(), field, join)

    def __call__(self, attrs: Any = None) -> Table:
        if self.other is None:
            return self.table.select(attrs) if attrs else self.table.clone()
        keys = {self.field: self.other.field}
        kind = next((k for k in (self.kind, self.other.kind) if k != "inner"), "inner")
        if kind == "inner":
            return self.table.join(self.other.table, attrs, **keys)
        return self.table.outer_join(kind, self.other.table, attrs, **keys)


__all__ = ["KINDS", "JoinTerm", "join_frames", "outputs", "pairs_of", "visible"]

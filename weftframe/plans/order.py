"""Row order without single-partition windows.

A table's order is a list of sort keys over its columns. Where consecutive numbers are wanted, the rows are range-sorted once and written with the
ids their partitions give them; the partitions' sizes, one number each, turn ids into positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stash

PART, POS, NUMBER = "_wf_part", "_wf_pos", "_wf_n"
BLOCK = 16  # rows of a block as a power of two


@dataclass(frozen=True)
class Key:
    name: str
    descending: bool = False

    def column(self) -> Column:
        c = F.col(f"`{self.name}`")
        return c.desc_nulls_first() if self.descending else c.asc_nulls_last()

    def flipped(self) -> Key:
        return Key(self.name, not self.descending)


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_wf_")]


def positioned(df: DataFrame) -> DataFrame:
    """With the order in which the frame's own plan gives its rows."""
    return df if POS in df.columns else df.withColumns({PART: F.lit(0).cast("bigint"), POS: F.monotonically_increasing_id()})


def natural() -> list[Key]:
    return [Key(PART), Key(POS)]


def columns(keys: list[Key]) -> list[Column]:
    return [k.column() for k in keys]


def numbered(df: DataFrame, keys: list[Key], name: str = NUMBER) -> DataFrame:
    """With consecutive numbers from 0 in the order of keys, which must decide between all rows."""
    held = stash(df.drop(name).orderBy(*columns(keys)).withColumn("_wf_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_wf_id", 33)
    sizes = held.groupBy(part.alias("_wf_p")).agg(F.count("*").alias("_wf_c"))
    # one row for each task of the sort: a window over them in one task is small
    starts = sizes.select("_wf_p", (F.sum("_wf_c").over(Window.orderBy("_wf_p")) - F.col("_wf_c")).alias("_wf_s"))
    joined = held.withColumn("_wf_p", part).join(starts, "_wf_p")
    return joined.withColumn(name, F.col("_wf_s") + F.col("_wf_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_wf_id", "_wf_p", "_wf_s")


def runs(df: DataFrame, group: list[Column], keys: list[Key], name: str = "_wf_run", partition: list[str] | None = None) -> DataFrame:
    """With the number of the row that begins the run of equal group values which each row belongs to.

    With partition, runs are those within each of its groups, and numbers count within it. Otherwise rows are numbered over all, runs
    are found in blocks of 2**BLOCK rows, and what crosses blocks is carried over from one summary row a block.
    """
    value = F.struct(*[g.alias(f"g{i}") for i, g in enumerate(group)])
    if partition:
        by = Window.partitionBy(*partition).orderBy(*columns(keys))
        n = df.withColumns({NUMBER: F.row_number().over(by).cast("bigint") - 1, "_wf_v": value})
        fresh = (F.col(NUMBER) == 0) | ~F.col("_wf_v").eqNullSafe(F.lag("_wf_v").over(by))
        n = n.withColumn("_wf_b", F.when(fresh, F.col(NUMBER)))
        return n.withColumn(name, F.max("_wf_b").over(by)).drop("_wf_b", "_wf_v", NUMBER)
    n = numbered(df, keys).withColumns({"_wf_k": F.shiftright(NUMBER, BLOCK), "_wf_v": value})
    by = Window.partitionBy("_wf_k").orderBy(NUMBER)
    before = n.groupBy((F.col("_wf_k") + 1).alias("_wf_k")).agg(F.max_by("_wf_v", NUMBER).alias("_wf_last"))
    n = n.join(before, "_wf_k", "left").withColumn("_wf_prev", F.when(F.row_number().over(by) == 1, F.col("_wf_last")).otherwise(F.lag("_wf_v").over(by)))
    n = n.withColumn("_wf_b", F.when((F.col(NUMBER) == 0) | ~F.col("_wf_v").eqNullSafe(F.col("_wf_prev")), F.col(NUMBER)))
    n = n.withColumn("_wf_own", F.max("_wf_b").over(by))
    ends = n.groupBy("_wf_k").agg(F.max("_wf_b").alias("_wf_e"))
    carried = ends.select("_wf_k", F.max("_wf_e").over(Window.orderBy("_wf_k").rowsBetween(Window.unboundedPreceding, -1)).alias("_wf_in"))
    return n.join(carried, "_wf_k").withColumn(name, F.coalesce("_wf_own", "_wf_in")).drop("_wf_k", "_wf_v", "_wf_last", "_wf_prev", "_wf_b", "_wf_own", "_wf_in", NUMBER)

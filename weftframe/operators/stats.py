"""Statistics of numeric columns, one pass for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import stash

NAMES = ["mean", "median", "min", "max", "variance", "std_dev", "count", "missing"]


def shortened(c: Column) -> Column:
    """To 4 decimals less one for each digit before the point; values up to 1 stay."""
    digits = F.greatest(F.lit(4) - F.floor(F.log10(F.abs(c))) - 1, F.lit(0))
    scale = F.pow(F.lit(10.0), digits)
    return F.when(F.abs(c) > 1, F.rint(c * scale) / scale).otherwise(c)


def numeric(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if isinstance(df.schema[n].dataType, T.NumericType)]


def medians(df: DataFrame, names: list[str]) -> DataFrame:
    """(i, median) of each column, exact. Distinct values with their counts are range-sorted and written; sums of their partitions turn counts into ranks."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{n}`").cast("double").alias("v")) for i, n in enumerate(names)])).alias("r")).select("r.*").where("v is not null")
    counts = long.groupBy("i", "v").agg(F.count("*").alias("c"))
    held = stash(counts.orderBy("i", "v").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "values")
    each = Window.partitionBy("i")  # a row for each partition of the sort
    starts = held.groupBy("i", "part").agg(F.sum("c").alias("s")).select("i", "part", (F.sum("s").over(each.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(each).alias("n"))
    high = F.col("before") + F.sum("c").over(Window.partitionBy("i", "part").orderBy("v"))
    ranked = held.join(starts, ["i", "part"]).withColumn("high", high).withColumn("low", F.col("high") - F.col("c"))
    at = lambda rank: F.max(F.when((F.col("low") <= rank) & (F.col("high") > rank), F.col("v")))
    return ranked.groupBy("i").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"))


def by_field(df: DataFrame, names: list[str], rounded: bool = True) -> DataFrame:
    """name and NAMES, a row for each column; the median is exact."""
    aggs = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`").cast("double")
        aggs += [F.avg(c).alias(f"mean{i}"), F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}"), F.var_samp(c).alias(f"variance{i}"), F.stddev_samp(c).alias(f"std_dev{i}"), F.count(c).alias(f"count{i}")]
    one = df.agg(F.count("*").alias("total"), *aggs).where("total > 0")
    if names:  # a row for each column
        found = medians(df, names).agg(F.map_from_entries(F.collect_list(F.struct("i", "median"))).alias("medians"))
        one = one.crossJoin(found).withColumns({f"median{i}": F.col("medians")[i] for i in range(len(names))})  # one row and one row
    cut = {"mean", "median", "variance", "std_dev"} if rounded else set()
    rows = [
        F.struct(
            F.lit(n).alias("name"),
            *[(shortened(F.col(f"{s}{i}")) if s in cut else F.col(f"{s}{i}")).alias(s) for s in NAMES[:-2]],
            F.col(f"count{i}").alias("count"),
            (F.col("total") - F.col(f"count{i}")).alias("missing"),
        )
        for i, n in enumerate(names)
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "name string, " + ", ".join(f"{s} double" for s in NAMES[:-2]) + ", count bigint, missing bigint")
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def by_statistic(df: DataFrame, names: list[str], rounded: bool = True) -> DataFrame:
    """stat and a column for each field, a row for each statistic."""
    long = by_field(df, names, rounded).select("name", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for i, s in enumerate(NAMES)])).alias("r")).select("name", "r.*")
    return long.groupBy("i", "stat").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names]).orderBy("i").drop("i")

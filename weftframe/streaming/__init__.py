"""Streams: stateless table operations work on a streaming frame as on any other; late data is bounded by a watermark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..table import Table


def follow(spark: SparkSession, path: str, schema: Any, kind: str = "parquet", **options: Any) -> Table:
    """A table over the files that arrive in a folder; where(), select() and compute_field() with Columns apply."""
    return Table(df=spark.readStream.format(kind).schema(schema).options(**options).load(path))


def summarized(table: Table, time: str, late: str, width: str, by: list[str], **aggregates: Column) -> DataFrame:
    """Summaries by tumbling windows of event time; rows later than `late` are dropped."""
    window = F.window(time, width)
    stamped = table.frame.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(window.alias("window"), *by).agg(*[c.alias(n) for n, c in aggregates.items()]).select("window.start", "window.end", *by, *aggregates)


def write(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()

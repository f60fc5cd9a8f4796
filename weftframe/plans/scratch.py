"""Tables in the folder that all executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []

#: Spark deletes a write's shuffle files when it is done, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary folder of a local session's own; on a cluster that raises an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='weftframe-')}")
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stash(df: DataFrame, name: str, release: bool = False, batch: tuple[int, int] | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back. release: its shuffle files are deleted at once. batch: rows and bytes that are sent to Python at a time."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    wanted = ({RELEASE: "true"} if release else {}) | (dict(zip(BATCHES, map(str, batch), strict=True)) if batch else {})
    was = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def product(sets: list[DataFrame], most: float = 1e9) -> DataFrame:
    """The cross join of sets of distinct values, for dense grids; an error where it would have more than `most` rows."""
    size = math.prod(values.count() for values in sets) if len(sets) > 1 else 0
    if size > most:
        raise ValueError(f"a dense grid of {size} cells; ask for existing combinations instead")
    out = sets[0]
    for values in sets[1:]:
        out = out.crossJoin(values)
    return out


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process wrote; frames that read them can't be used any more. How many there were."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone

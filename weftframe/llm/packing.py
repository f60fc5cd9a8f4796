"""Packing of documents into training sequences by the sum-of-squares rule.

A sequence (bin) holds `capacity` words. A document longer than that fills whole sequences of its own first; its rest is placed like
a short document: where the sum over residual gaps g of (open bins with gap g)^2 becomes smallest; ties go to the smallest
resulting gap, then to an existing bin before a new one. Packing is local to a shard: shards are hashes of the row and of its number among
equal rows, so that any number of copies spreads over all shards; their number follows from the row count (`rows_per_shard`). The texts are read once,
and only ids and lengths are shuffled.

Defined results: a null or empty text, or one of white space only, has length 0 and takes no place: bin null, 0 words. Repeated rows and
repeated ids are packed each on their own; a null doc_id is passed on; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared

SCHEMA = "did bigint, n_words bigint, part int, part_start bigint, part_words int, bin string, bin_start int"
CHUNK = 1 << 16
SCHEMA_REST = ["n_words", "part", "part_start", "part_words", "bin", "bin_start"]


class SumOfSquares:
    """Places items one by one; counts[g] is the number of open bins with gap g."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = defaultdict(list)  # gap -> bins, the last opened last
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, words in it before) for an item of 1 to capacity words."""
        c, most = self.counts, self.capacity
        # change of the sum: bin g loses one (-2c[g]+1), gap g-size gains one (2c[g-size]+1); full bins (gap 0) are closed
        gaps = size + np.flatnonzero(c[size:])
        best, change = most, (2 * c[most - size] + 1 if size < most else 0)  # a new bin
        if len(gaps):
            left = gaps - size
            d = np.where(left > 0, 2 * c[left] + 1, 0) - 2 * c[gaps] + 1
            k = int(np.argmin(d))  # the smallest gap of those that tie
            if (d[k], left[k]) <= (change, most - size):
                best, change = int(gaps[k]), d[k]
                at = self.open[best].pop()
                c[best] -= 1
            else:
                at = self._new()
        else:
            at = self._new()
        rest = best - size
        if rest:
            c[rest] += 1
            self.open[rest].append(at)
        return at, most - best

    def _new(self) -> int:
        self.bins += 1
        return self.bins - 1


def pack_shard(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(item, part, part_start, part_words, bin, bin_start) for items in the given order; whole parts have bins of their own."""
    packer, out = SumOfSquares(capacity), []
    for i, n in enumerate(lengths):
        whole, rest = divmod(int(n), capacity)
        for p in range(whole):
            out.append((i, p, p * capacity, capacity, packer._new(), 0))
        if rest:
            out.append((i, whole, whole * capacity, rest, *packer.place(rest)))
    return out


def pack(docs: DataFrame, capacity: int = 2048, rows_per_shard: int = 20_000) -> DataFrame:
    """One row for each part of each document: the sequence (bin) that holds it and where it begins there."""
    sized = docs.select(
        _shared.id_column().alias("did"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x20]+")), F.lit(0)).cast("bigint").alias("n_words"),
        F.xxhash64("doc_id", "text").alias("key"),
    )
    sized = _shared.stash(sized.groupBy("did", "n_words", "key").agg(F.count("*").alias("copies")), "lengths")
    shards = max(1, -(-(sized.agg(F.sum("copies")).first()[0] or 0) // rows_per_shard))
    # equal rows are numbered, in two steps as an array has a largest size
    each = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / CHUNK))))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK) - 1)))
    each = each.select("did", "n_words", "key", "copy", F.pmod(F.xxhash64("key", "copy"), F.lit(shards)).alias("shard"))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "did", "copy"], ignore_index=True)  # the same packing whatever order rows come in
        none = pdf[pdf["n_words"] == 0]
        pdf = pdf[pdf["n_words"] > 0]
        rows = pack_shard(pdf["n_words"].tolist(), capacity)
        name = int(pdf["shard"].iloc[0]) if len(pdf) else 0
        i = np.array([r[0] for r in rows], np.int64)
        zero = [0] * len(none)
        return pd.DataFrame(
            {
                "did": np.append(pdf["did"].to_numpy()[i], none["did"].to_numpy()),
                "n_words": np.append(pdf["n_words"].to_numpy()[i], none["n_words"].to_numpy()),
                "part": [r[1] for r in rows] + zero,
                "part_start": [r[2] for r in rows] + zero,
                "part_words": [r[3] for r in rows] + zero,
                "bin": [f"{name}-{r[4]}" for r in rows] + [None] * len(none),
                "bin_start": pd.array([r[5] for r in rows] + [None] * len(none), "Int32"),
            }
        )

    return each.groupBy("shard").applyInPandas(shard, SCHEMA).select(_shared.real_id().alias("doc_id"), *SCHEMA_REST)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

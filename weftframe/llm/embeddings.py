"""Near-duplicate embeddings by spherical-cap filters.

A rotated unit vector is cut into two parts; each part has `codes` random unit codewords, and every pair of codewords is a filter direction (a
structured random product code, so codes ** 2 directions cost 2 * codes inner products). There are `rotations` such codes, as filters of one code
go wrong together. List decoding extends codewords of the first part only while the best completion can still reach the height; it returns every filter
whose cap of that height holds the vector, and the nearest filter of each code, so that no vector is without one. Vectors that share a filter are
compared exactly.

The search is approximate. Its height is the largest at which, in a simulation of pairs that lie exactly at the threshold, the share `recall` of them shares
a filter; closer pairs do so more often. The number of directions follows from that of the vectors: as many as it takes for a bucket to hold
about `load` vectors without duplicates, so that buckets don't grow with the corpus. Each number of elements has filters of its own.

A pair meets in every filter that both lie in, and counts in the first of them only: vectors travel with the filters they lie in before this
one. A bucket of more than `block` vectors is compared in pairs of blocks, each in memory by itself. What leaves a task is a number of links for each
vector and one edge at most for each vector, which tie together what is linked; pairs are never written out.

Defined results: one row for each row of the table, with the class of linked vectors it belongs to and how many vectors it is linked to. Identical
vectors are compared once, and each distinct vec_id counts. A null vector, one with a null, infinite or NaN element or of length zero, and a row with
a null vec_id have no class and no links; vectors of unequal numbers of elements are never linked. class_id is the smallest vec_id of the class, null for
a vector without links. Rows with equal id and vector count once; rows with one id and several vectors are vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from .jaccard import tied

PAIRS = 256
WIDTH = 4096


def turns(dim: int, rotations: int) -> list[np.ndarray]:
    """Random orthogonal maps to an even number of elements."""
    rng, full = np.random.default_rng(13), dim + dim % 2
    return [np.linalg.qr(rng.standard_normal((full, full)))[0][:, :dim].T.astype(np.float32) for _ in range(rotations)]


@dataclass
class Caps:
    """The filters for vectors of one number of elements."""

    dim: int
    codes: int
    rotations: int
    height: float = 0.0
    turns: list[np.ndarray] | None = None

    def __post_init__(self):
        self.width = -(-self.dim // 2)
        self.turns = self.turns or turns(self.dim, self.rotations)
        words = np.random.default_rng(11).standard_normal((self.rotations, 2, self.codes, self.width))
        self.words = (words / np.linalg.norm(words, axis=3, keepdims=True) / np.sqrt(2)).astype(np.float32)

    def __reduce__(self):  # the directions are drawn anew where they are used
        return Caps, (self.dim, self.codes, self.rotations, self.height)

    def scores(self, x: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.turns[turn]
        return y[:, : self.width] @ self.words[turn, 0].T, y[:, self.width :] @ self.words[turn, 1].T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), ascending, for unit rows x: all filters whose inner product reaches the height, and the nearest one of each code."""
        rows, found = [], []
        for turn in range(self.rotations):
            first, second = self.scores(x, turn)
            row, a = np.nonzero(first + second.max(1)[:, None] >= self.height)
            i, b = np.nonzero(first[row, a][:, None] + second[row] >= self.height)
            rows += [row[i], np.arange(len(x))]
            found += [(turn * self.codes + a[i].astype(np.int64)) * self.codes + b, (turn * self.codes + first.argmax(1)) * self.codes + second.argmax(1)]
        row, code = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        new = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)]
        return row[new], code[new]

    def fitted(self, threshold: float, recall: float) -> float:
        """Sets the height; returns how many filters hold a random vector."""
        rng = np.random.default_rng(12)
        x, z = rng.standard_normal((2, PAIRS, self.dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * z
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        best, sizes = np.full(PAIRS, -2.0), []
        top = min(self.codes, 128)
        for turn in range(self.rotations):
            sx, sy = (self.scores(v.astype(np.float32), turn) for v in (x, y))
            near = [np.argpartition(-(a + b), top - 1, axis=1)[:, :top] for a, b in zip(sx, sy, strict=True)]
            ax, bx, ay, by = (np.take_along_axis(s[k], near[k], 1) for s in (sx, sy) for k in (0, 1))
            common = np.minimum(ax[:, :, None] + bx[:, None, :], ay[:, :, None] + by[:, None, :])
            best = np.maximum(best, common.reshape(PAIRS, -1).max(1))
            sizes.append((sx[0], np.sort(sx[1], axis=1)))
        self.height = float(np.quantile(best, 1 - recall, method="lower")) - 1e-6
        return float(np.mean([sum(self.codes - np.searchsorted(second[p], self.height - first[p]).astype(np.int64).mean() for first, second in sizes) * self.codes for p in range(PAIRS)]))


def caps_for(dim: int, vectors: int, threshold: float, recall: float, rotations: int, load: float) -> Caps:
    """The fewest directions at which a bucket holds about `load` of that many vectors, as far as more directions make buckets smaller."""
    last, codes, turned = None, 16, turns(dim, rotations)
    while True:
        caps = Caps(dim, codes, rotations, turns=turned)
        held = vectors * caps.fitted(threshold, recall) / (rotations * codes**2)
        if last is not None and held > 0.9 * last[1]:
            return last[0]
        if held <= load:
            return caps
        last, codes = (caps, held), codes * 3 // 2


def unit(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def met_before(hit: np.ndarray, before: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right: whether a filter before this one holds both; where there is a hit."""
    flat = np.concatenate(before)
    if not len(flat):
        return np.zeros_like(hit)
    row = np.repeat(np.arange(len(before)), [len(b) for b in before])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    most = int(column[-1]) + 1 if len(column) else 0
    out = np.zeros(hit.shape, bool)
    for at in range(0, most, WIDTH):
        a, b = np.searchsorted(column, (at, at + WIDTH))
        m = np.zeros((len(before), min(WIDTH, most - at)), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out |= m[left] @ m[right].T > 0
    return out


def bucket(x: np.ndarray, copies: np.ndarray, own: np.ndarray, i: int, j: int, before: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Links counted here and first tied row of each of the bucket's vectors; None where nothing is linked."""
    left, right = (np.arange(len(x)),) * 2 if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
    if not len(left) or not len(right):
        return None
    hit = x[left] @ x[right].T >= threshold - 1e-9
    if i == j:
        np.fill_diagonal(hit, False)
    if not hit.any():
        return None
    some = np.union1d(left[hit.any(1)], right[hit.any(0)])
    lists = [np.frombuffer(before[k], np.int64) for k in some.tolist()]
    if (np.unique(np.concatenate(lists), return_counts=True)[1] == len(some)).any():  # an earlier filter held them all
        return None
    label = tied(hit, left, right, len(x))
    hit &= ~met_before(hit, [np.frombuffer(b, np.int64) for b in before], left, right)
    count = np.zeros(len(x), np.int64)
    count[left] += hit @ copies[right]
    if i != j:
        count[right] += copies[left] @ hit
    return count, label


def near(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.97, rotations: int = 4, load: float = 8, block: int = 1024) -> DataFrame:
    """vec_id, class_id and links (the number of other vectors with a cosine of at least threshold) for each row."""
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    known = vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    known = known.select("id", F.when(sound, F.col("v")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zero
            ends = np.append(0, np.cumsum(np.nan_to_num(v.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)))
            some = v.is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() if k else None for a, b, k in zip(ends, ends[1:], some, strict=False)], pa.binary())], ["id", "v"])

    rows = _shared.stash(known.mapInArrow(pack, "id bigint, v binary").withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "vectors")
    whole = rows.where("node is not null")
    owners = whole.select("id", "node").distinct().groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    reps = _shared.stash(whole.groupBy("node").agg(F.first("v").alias("v")).join(owners, "node"), "representatives")
    width = np.dtype(kind).itemsize
    caps = {r["n"] // width: caps_for(r["n"] // width, r["count"], threshold, recall, rotations, load) for r in reps.groupBy(F.length("v").alias("n")).count().collect()}  # a row for each number of elements

    def decoded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, number of elements, filter) of up to 512 vectors at a time, by row and filter."""
        size = np.array([len(v) // width for v in batch.column(1).to_pylist()])
        for dim in np.unique(size).tolist():
            own = np.flatnonzero(size == dim)
            for at in range(0, len(own), 512):
                part = own[at : at + 512]
                row, code = caps[dim].decode(unit(batch.column(1).take(pa.array(part)).to_pylist(), kind).astype(np.float32))
                yield part[row], np.full(len(row), dim), code

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, dim, code in decoded(batch):
                found, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(dim[: len(found)].astype(np.int32)), pa.array(found), pa.array(n)], ["dim", "code", "n"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, dim, code in decoded(batch):
                take = pa.array(row)
                start = np.searchsorted(row, row)  # rows ascend
                before = [code[a:b].tobytes() for a, b in zip(start.tolist(), range(len(code)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(dim.astype(np.int32)), pa.array(code), *(batch.column(c).take(take) for c in range(3)), pa.array(before, pa.binary())], ["dim", "code", "node", "v", "copies", "before"])

    slim = reps.select("node", "v", "copies")
    large = slim.mapInArrow(count, "dim int, code bigint, n bigint").groupBy("dim", "code").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    large = _shared.stash(large.select("dim", "code", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-buckets")
    filtered = slim.mapInArrow(decode, "dim int, code bigint, node bigint, v binary, copies bigint, before binary").join(large, ["dim", "code"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    filtered = filtered.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = filtered.select("dim", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "v", "copies", "before")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            dim, code, i, j, own, node, copies = (table[c].to_numpy() for c in ("dim", "code", "i", "j", "own", "node", "copies"))
            raw, before = table["v"].to_pylist(), table["before"].to_pylist()
            change = (dim[1:] != dim[:-1]) | (code[1:] != code[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            ends = np.flatnonzero(np.append(change, True)) + 1
            a, b, n, at = [], [], [], 0
            for end in ends.tolist():
                if end - at > 1 and (found := bucket(unit(raw[at:end], kind), copies[at:end], own[at:end], int(i[at]), int(j[at]), before[at:end], threshold)):
                    links, label = found
                    some, tie = np.flatnonzero(links), np.flatnonzero(label != np.arange(end - at))
                    a += [node[at + some], node[at + tie]]
                    b += [np.zeros(len(some), np.int64), node[at + label[tie]]]
                    n += [links[some], np.zeros(len(tie), np.int64)]
                at = end
            if a:
                n = np.concatenate(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b), mask=n > 0), pa.array(n)], ["a", "b", "n"])

        held: list[pa.RecordBatch] = []
        key = lambda batch, row: tuple(batch.column(c)[row].as_py() for c in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            tail = key(batch, batch.num_rows - 1)
            same = np.ones(batch.num_rows, bool)
            for c, v in enumerate(tail):
                same &= batch.column(c).to_numpy() == v
            last = int(same.argmax())  # the last bucket may go on in the next batch
            if last == 0 and held and key(held[-1], 0) == tail:
                held.append(batch)
                continue
            if held or last:
                yield from close([*held, batch.slice(0, last)] if last else held)
            held = [batch.slice(last)]
        if held:
            yield from close(held)

    order = ["dim", "code", "i", "j"]
    found = _shared.stash(keyed.repartition(*order).sortWithinPartitions(*order).mapInArrow(verify, "a bigint, b bigint, n bigint"), "links")
    result = _shared.classes(reps, found)
    return rows.join(result, "node", "left").select(rows["id"].alias("vec_id"), "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def op7_embedding_caps(spark, sf_dir: str) -> DataFrame:
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE reps AS (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS rep, count(*) AS copies FROM embeddings GROUP BY 1),
pair AS (SELECT a.rep AS a, b.rep AS b, b.copies FROM reps a JOIN reps b ON a.rep != b.rep WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
class AS (SELECT a AS rep, least(a, min(b)) AS class_id FROM reach GROUP BY a),
near AS (SELECT a AS rep, sum(copies) AS links FROM pair GROUP BY a),
found AS (
  SELECT r.v, coalesce(c.class_id, r.rep) AS class_id, r.copies - 1 + coalesce(n.links, 0) AS links
  FROM reps r LEFT JOIN class c USING (rep) LEFT JOIN near n USING (rep))
SELECT e.vec_id, CASE WHEN f.links > 0 THEN f.class_id END AS class_id, CAST(f.links AS BIGINT) AS links
FROM embeddings e JOIN found f ON f.v = e.embedding::DOUBLE[]
"""

"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as plain words (lower case, punctuation off, one blank between words), in bytes. An item with room for
e edits is split into e + 1 pieces: within e edits at least one piece stays whole. An Aho-Corasick automaton finds all
whole pieces in the texts; around each hit Myers' bit-parallel algorithm computes the smallest edit distance between the item and
any passage there. An item too short for any edit is one piece, found as whole words only.

The plain items are written to the shared folder in parts of about `part_bytes`, by a hash; the driver holds none of them. The texts are read once: a task
takes about `chunk_bytes` of them at a time and loads one part after the other, or keeps the only one.

Defined results: null, empty or punctuation-only texts and items match nothing. A null doc_id or item_id is passed on. Repeated rows are reported as
often as they occur; repeated items with one id count as one. Extra columns are ignored, and carried along by drop_contaminated().
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text

SCHEMA = "doc_id bigint, item_id bigint, distance int, budget int"


def budget(size: int, rate: float) -> int:
    return int(size * rate)


def split(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces, as even as can be; without edits, the item as whole words."""
    if not edits:
        return [(-1, f" {item} ")]
    bounds = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def myers(masks: dict[str, int], size: int, text: str, most: int) -> int:
    """The smallest edit distance between the pattern and any passage of text; most + 1 where it is larger than most."""
    full, top = (1 << size) - 1, 1 << size >> 1
    plus, minus, score, best = full, 0, size, min(size, most + 1)
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up = minus | ~(d0 | plus) & full
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # a passage may begin anywhere: no 1 comes in
        down = down << 1 & full
        plus = down | ~(d0 | up) & full
        minus = up & d0
        if score < best:
            best = score
    return best


class Matcher:
    """All items of one part."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.ids = [i for i, _ in items]
        self.items = [t for _, t in items]
        self.edits = [budget(len(t), rate) for t in self.items]
        self.masks: list[dict[str, int]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.items):
            masks: dict[str, int] = {}
            for i, c in enumerate(t):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks.append(masks)
            for at, piece in split(t, self.edits[k]):
                pieces[piece].append((k, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.auto.add_word(piece, (len(piece), tuple(where)))
        if pieces:
            self.auto.make_automaton()

    def matches(self, low: str, at: list[int]) -> Iterator[tuple[int, int, int]]:
        """(row, item, distance) for the rows low[at[r]:at[r + 1]], each word with a blank after it and one before the first row."""
        if not self.items or not low:
            return
        starts: dict[tuple[int, int], list[int]] = defaultdict(list)
        bounds = np.array(at)
        ends, found = [], []
        for end, value in self.auto.iter(low):
            ends.append(end)
            found.append(value)
        rows = np.searchsorted(bounds, np.array(ends, np.int64), "right") - 1
        for end, (size, where), row in zip(ends, found, rows.tolist(), strict=True):
            for k, offset in where:
                starts[row, k].append(end + 1 - size - offset)
        for (row, k), begins in starts.items():
            item, e = self.items[k], self.edits[k]
            lo, hi = at[row], at[row + 1]
            if not e:  # found as a whole; but it may begin in the row before
                if max(begins) >= lo:
                    yield row, k, 0
                continue
            best = e + 1
            begins.sort()
            group = [begins[0], begins[0]]
            windows = [group]
            for b in begins[1:]:
                if b - group[1] <= 2 * e:
                    group[1] = b
                else:
                    group = [b, b]
                    windows.append(group)
            for a, b in windows:
                text = low[max(lo, a - e) : min(hi, b + len(item) + e)]
                best = min(best, 0 if item in text else myers(self.masks[k], len(item), text, e))
                if not best:
                    break
            if best <= e:
                yield row, k, best


def parts(benchmark: DataFrame, part_bytes: int) -> list[str]:
    """Folders of the plain items, of about part_bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [_text.plain_text(t) for t in batch.column(1).to_pylist()]
            keep = pa.array([bool(p) for p in plain])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.string())], ["item_id", "plain"]).filter(keep)

    items = _shared.stash(benchmark.select(F.col("item_id").cast("bigint"), "text").where("text is not null").mapInArrow(run, "item_id bigint, plain string").distinct(), "items")
    total = items.agg(F.sum(F.length("plain"))).first()[0]
    if not total:
        return []
    count = -(-total // part_bytes)
    folder = _shared.scratch_path(items.sparkSession, "item-parts")
    items.withColumn("part", F.pmod(F.xxhash64("item_id", "plain"), F.lit(count))).repartition("part").write.partitionBy("part").parquet(folder)
    fs, path = pafs.FileSystem.from_uri(folder)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("part="))
    return [f"{folder}/{name}" for name in names]


def load(folder: str, rate: float) -> Matcher:
    fs, path = pafs.FileSystem.from_uri(folder)
    table = pads.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False, ignore_prefixes=["_", "."]).to_table(columns=["item_id", "plain"])
    rows = zip(table["item_id"].to_pylist(), table["plain"].to_pylist(), strict=True)
    return Matcher(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), rate)


def _scan(matcher: Matcher, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    low, at = _text.plain(data, off)
    return sorted(matcher.matches(" " + low.tobytes().decode("latin-1"), (at + 1).tolist()))


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]]:
    """The pieces of batches, as many at a time as hold about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        for piece in _text.pieces(batch, most=1 << 20):
            held.append(piece)
            size += len(piece[1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def scanned(batches: Iterator[pa.RecordBatch], folders: list[str], rate: float, chunk_bytes: int) -> Iterator[tuple[Matcher, pa.RecordBatch, list[tuple[int, int, int]], bool]]:
    """Each piece with each part's hits in it; True with its last part."""
    only = load(folders[0], rate) if len(folders) == 1 else None
    for held in chunks(batches, 1 if only else chunk_bytes):
        for k, folder in enumerate(folders):
            own = only or load(folder, rate)
            for part, data, off in held:
                yield own, part, _scan(own, data, off), k + 1 == len(folders)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, part_bytes: int = 4 << 20, chunk_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, item_id, distance, budget): items that occur in documents within their budget, rate times their length in edits."""
    folders = parts(benchmark, part_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part, hits, _ in scanned(batches, folders, rate, chunk_bytes):
            if hits:
                ids = part.column(0).take(pa.array([h[0] for h in hits]))
                rest = [pa.array([own.ids[h[1]] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32()), pa.array([own.edits[h[1]] for h in hits], pa.int32())]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "item_id", "distance", "budget"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, part_bytes: int = 4 << 20, chunk_bytes: int = 64 << 20) -> DataFrame:
    """The rows, all columns, in which no item occurs within its budget."""
    folders = parts(benchmark, part_bytes)
    if not folders:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: dict[int, np.ndarray] = {}
        for _, part, hits, last in scanned(batches, folders, rate, chunk_bytes):
            mask = keep.setdefault(id(part), np.ones(part.num_rows, bool))  # a chunk's pieces stay alive until its last part
            mask[[h[0] for h in hits]] = False
            if last:
                yield part.filter(pa.array(keep.pop(id(part))))

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

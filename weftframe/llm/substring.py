"""Repeated passages by super-k-mers.

Words are runs of bytes above the blank, compared exactly. A window is `k` consecutive words; its minimiser is the smallest hash among
its `m`-word grams. Consecutive windows with one minimiser form a super-k-mer, which travels as one packed string to
the minimiser's bucket, where sorting the windows of all strings counts them exactly.

1. A pass emits each super-k-mer's place and minimiser only. Equal windows have equal minimisers, so a super-k-mer whose minimiser
   occurs once in the whole corpus can't hold a repeated window and goes no further.
2. The others are packed. Equal strings are combined before they travel, so a passage in millions of copies is one record with a count
   and its first place.
3. Each bucket sorts its windows, adds up the counts, and finds where each window occurs first: in order of doc_id, then position. Many buckets are
   sorted at once: words become numbers, and numbers of words numbers of ever longer runs of words, up to k, by sorting; equal numbers
   mean equal windows. A super-k-mer of more than LONGEST windows travels as several, so equal pieces of a long repetition are one string.
4. The windows of a bucket with more than `most` bytes of different strings are sorted by Spark instead, as pairs of hashes with their places,
   so that no task holds a bucket whose minimiser is common.
5. The findings go back to all places of each string.

Defined results: a text of fewer than k words, null and empty ones included, has no windows. A null doc_id sorts first and is
reported as null. Rows that share id and text share their place: both count, and both are where the window occurs first.
Repetition within one document counts. Extra columns are ignored, and carried along by cut().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared, _text

U = np.uint64
LONGEST = 512


def super_kmers(h: np.ndarray, rows: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, minimiser, and whether the minimiser's gram occurs more than once in it; for each super-k-mer."""
    none = np.zeros(0, np.int64)
    wide = k - m + 1
    grams, _ = _text.ngrams(h, rows, m)
    left = np.repeat(rows[1:], np.diff(rows)) - np.arange(len(h))
    at = np.flatnonzero(left >= k)
    if not len(at):
        return none, none, none.view(U), none.astype(bool)
    least, reach = grams, 1
    while reach < wide:  # minimum of the next `reach` grams, doubling
        step = min(reach, wide - reach)
        least = np.append(np.minimum(least[:-step], least[step:]), least[-step:])
        reach += step
    mini = least[at]
    new = np.ones(len(at), bool)
    row = _text.rows_of(rows)[at]
    new[1:] = (mini[1:] != mini[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    parts = -(-count // LONGEST)
    start, mini, left = np.repeat(at[first], parts), np.repeat(mini[first], parts), np.repeat(count, parts)
    nth = (np.arange(len(start)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST
    start, count = start + nth, np.minimum(left - nth, LONGEST)
    view = np.lib.stride_tricks.sliding_window_view(grams, wide)
    a = start + (view[start] == mini[:, None]).argmax(1)
    end = start + count - 1
    b = end + wide - 1 - (view[end][:, ::-1] == mini[:, None]).argmax(1)
    return start, count, mini, a != b


def places(docs: DataFrame, k: int, m: int) -> DataFrame:
    """did, th, start, windows, mini, weight: weight 2 where equal windows may occur within the super-k-mer itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in _text.pieces(batch, most=1 << 20):
                starts, ends, rows = _text.spans(data, off, _text.BLANK)
                start, count, mini, twice = super_kmers(_text.word_hashes(data, starts, ends), rows, k, m)
                if not len(start):
                    continue
                row = np.searchsorted(rows, start, "right") - 1
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array((start - rows[row]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(mini.view(np.int64)), pa.array(1 + twice.astype(np.int32))],
                    ["did", "th", "start", "windows", "mini", "weight"],
                )

    return docs.select("did", "th", "text").mapInArrow(run, "did bigint, th bigint, start int, windows int, mini bigint, weight int")


def packed(docs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """did, th, start, mini, words: the packed strings of the super-k-mers that found lists."""
    per_row = found.groupBy("did", "th").agg(F.array_sort(F.collect_set(F.struct("start", "windows", "mini"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in _text.pieces(batch, most=1 << 20):
                starts, ends, rows = _text.spans(data, off, _text.BLANK)
                lists = part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                flat = lists.flatten()
                start, windows = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                first = rows[row] + start
                lo, hi = starts[first], ends[first + windows + k - 2]
                # white space of any kind and length becomes one blank
                blanked = np.where(data <= 32, 32, data).astype(np.uint8)
                keep = np.ones(len(data), bool)
                keep[1:] = (blanked[1:] != 32) | (blanked[:-1] != 32)
                place = np.append(0, np.cumsum(keep))
                tight = blanked[keep].tobytes()
                words = [tight[a:b] for a, b in zip(place[lo].tolist(), place[hi].tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), flat.field(0), flat.field(2), pa.array(words, pa.binary())], ["did", "th", "start", "mini", "words"])

    once = docs.join(per_row, ["did", "th"]).select("did", "th", "text", "found")
    return once.mapInArrow(run, "did bigint, th bigint, start int, mini bigint, words binary")


RUNS = "array<struct<x:int,y:int>>"
FOUND = f"mini bigint, a bigint, b bigint, did bigint, th bigint, start int, repeated {RUNS}, leading {RUNS}, rest {RUNS}"
RUN_TYPE = pa.struct([("x", pa.int32()), ("y", pa.int32())])


def runs(of: np.ndarray, at: np.ndarray, size: int) -> pa.ListArray:
    """For each of size strings the runs x to y (exclusive) of its numbers; of and at ascend together."""
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.flatnonzero(np.append(new, True)[1:]) if len(of) else first
    pairs = pa.StructArray.from_arrays([pa.array(at[first].astype(np.int32)), pa.array((at[last] + 1).astype(np.int32))], fields=list(RUN_TYPE))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[first], np.arange(size + 1)).astype(np.int32)), pairs)


def numbered(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers for each k consecutive ids, equal where those are equal."""
    width = 1
    while width < k:
        bits = max(1, int(ids.max()).bit_length())
        steps = sorted({min(j * width, k - width) for j in range(63 // bits)})
        size = len(ids) - steps[-1]
        if size <= 0:
            return np.zeros(0, np.int64)
        packed = np.zeros(size, np.int64)
        for s in steps:
            packed = packed << bits | ids[s : s + size]
        width += steps[-1]
        ids = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    return ids


def windows_of(strings: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's string, place in it and first word; and the starts and ends of all words in the strings' bytes, one blank between them."""
    text = np.frombuffer(b" ".join(strings.to_pylist()), np.uint8)
    blank = np.flatnonzero(text == 32)
    starts, ends = np.append(0, blank + 1), np.append(blank, len(text))
    size = np.diff(np.append(0, np.cumsum(np.asarray(pc.binary_length(strings)).astype(np.int64) + 1)))
    first = np.searchsorted(starts, np.cumsum(size) - size)
    count = np.diff(np.append(first, len(starts))) - k + 1
    of = np.repeat(np.arange(len(strings)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return of, at, first[of] + at, starts, ends


def count_windows(strings: pa.Array, count: np.ndarray, did: np.ndarray, th: np.ndarray, start: np.ndarray, k: int) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """For distinct strings of whole buckets, each with its count and first place, runs of windows: those that occur twice or more
    in all; of them those that occur first at this string's first place; and the others of them.
    """
    of, at, word, starts, ends = windows_of(strings, k)
    text = np.frombuffer(b" ".join(strings.to_pylist()), np.uint8)
    cuts = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(text[text != 32])])
    number = numbered(words.dictionary_encode().indices.to_numpy().astype(np.int64), k)[word]
    order = np.lexsort((start[of] + at, th[of], did[of], number))
    number, of, at = number[order], of[order], at[order]
    new = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    often = np.repeat(np.add.reduceat(count[of], new) > 1, np.diff(np.append(new, len(of))))
    leads = np.zeros(len(of), bool)
    leads[new] = True
    order = np.lexsort((at, of))
    of, at, often, leads = of[order], at[order], often[order], leads[order]
    return tuple(runs(of[m], at[m], len(strings)) for m in (often, often & leads, often & ~leads))


def counted(strings: DataFrame, k: int, most: int, together: int = 4 << 20) -> DataFrame:
    """Sorts and counts each bucket; one row for each distinct string with a repeated window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            words = table["words"].chunk(0)
            found = count_windows(words, *(table[c].to_numpy() for c in ("count", "did", "th", "start")), k)
            out = pa.RecordBatch.from_arrays([*(table[c].chunk(0) for c in ("mini", "a", "b", "did", "th", "start")), *found], ["mini", "a", "b", "did", "th", "start", "repeated", "leading", "rest"])
            yield out.filter(pa.array(np.asarray(found[0].value_lengths()) > 0))

        held, size = [], 0
        for batch in batches:
            for part, data, _ in _text.pieces(batch, "words", most=1 << 20):
                mini = part.column(0).to_numpy()
                if size > together and (new := np.flatnonzero(mini != held[-1].column(0)[-1].as_py())).size:
                    cut = int(new[0])  # the last bucket ends here
                    yield from close([*held, part.slice(0, cut)] if cut else held)
                    held, size, part = [], 0, part.slice(cut)
                held.append(part)
                size += len(data)
        if held:
            yield from close(held)

    distinct = strings.groupBy("mini", "words").agg(F.count("*").alias("count"), F.min(F.struct("did", "th", "start")).alias("first"))
    distinct = _shared.stash(distinct.select("mini", *fingerprint(), "first.did", "first.th", "first.start", "words", "count"), "strings")
    large = _shared.stash(distinct.groupBy("mini").agg(F.sum(F.length("words")).alias("bytes")).where(F.col("bytes") > most).select("mini"), "large-buckets")
    found = distinct.join(large, "mini", "left_anti").repartition("mini").sortWithinPartitions("mini").mapInArrow(run, FOUND)
    return found.union(counted_by_spark(distinct.join(large, "mini", "left_semi"), k)) if large.take(1) else found


def counted_by_spark(distinct: DataFrame, k: int) -> DataFrame:
    """The same for large buckets: windows as 128 bits, each a row."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in _text.pieces(batch, "words", most=1 << 20):
                starts, ends, rows = _text.spans(data, off, _text.BLANK)
                h = _text.word_hashes(data, starts, ends)
                one, ok = _text.ngrams(h, rows, k)
                two, _ = _text.ngrams(_text.mix(h + U(0x9E3779B97F4A7C15)) + (ends - starts).astype(U), rows, k)
                word = np.flatnonzero(ok)
                row = _text.rows_of(rows)[word]
                take = pa.array(row)
                own = [part.column(part.schema.get_field_index(c)).take(take) for c in ("mini", "a", "b", "did", "th", "start", "count")]
                yield pa.RecordBatch.from_arrays([pa.array(one[word].view(np.int64)), pa.array(two[word].view(np.int64)), pa.array((word - rows[row]).astype(np.int32)), *own], ["one", "two", "j", "mini", "a", "b", "did", "th", "start", "count"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(6)
            of = np.repeat(np.arange(batch.num_rows), np.asarray(marks.value_lengths()))
            at, leads = (marks.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            found = [runs(of[m], at[m], batch.num_rows) for m in (np.ones(len(of), bool), leads, ~leads)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *found], ["mini", "a", "b", "did", "th", "start", "repeated", "leading", "rest"])

    each = distinct.mapInArrow(explode, "one bigint, two bigint, j int, mini bigint, a bigint, b bigint, did bigint, th bigint, start int, count bigint")
    place = F.struct("did", "th", F.col("start") + F.col("j"), "a", "b", "j")
    often = each.groupBy("one", "two").agg(F.sum("count").alias("n"), F.min(place).alias("first")).where("n > 1").select("one", "two", "first")
    marked = each.join(often, ["one", "two"]).withColumn("leads", place == F.col("first"))
    # a string has LONGEST windows at most
    return marked.groupBy("mini", "a", "b", "did", "th", "start").agg(F.array_sort(F.collect_list(F.struct("j", "leads"))).alias("marks")).mapInArrow(joined, FOUND)


def fingerprint() -> list[Column]:
    """128 bits that stand for a string on the way back to its places."""
    return [F.xxhash64("words").alias("a"), F.xxhash64(F.lit(7), "words").alias("b")]


def repeats(docs: DataFrame, k: int = 50, m: int = 10, most: int = 8 << 20) -> DataFrame:
    """did, th, first, end, leads: maximal runs of consecutive windows, by the place of their first word, that occur twice or more in
    the corpus; leads tells whether the corpus has them nowhere earlier.
    """
    keyed = docs.select(_shared.id_column().alias("did"), _shared.row_key().alias("th"), "text")
    minis = _shared.stash(places(keyed, k, m), "minimisers")
    often = minis.groupBy("mini").agg(F.sum("weight").alias("n")).where("n > 1").select("mini")
    strings = _shared.stash(packed(keyed, minis.join(often, "mini"), k), "super-kmers")
    hits = counted(strings, k, most).withColumn("lead", F.struct("did", "th", "start")).drop("did", "th", "start")
    back = strings.select("did", "th", "start", "mini", *fingerprint()).join(hits, ["mini", "a", "b"])

    def marked(column: str, leads: bool) -> Column:
        return F.transform(column, lambda r: F.struct((F.col("start") + r.x).alias("first"), (F.col("start") + r.y).alias("end"), F.lit(leads).alias("leads")))

    here = F.struct("did", "th", "start") == F.col("lead")
    flat = back.select("did", "th", F.explode(F.when(here, F.concat(marked("leading", True), marked("rest", False))).otherwise(marked("repeated", False))).alias("r"))
    flat = flat.select("did", "th", "r.*").repartition("did", "th").dropDuplicates()
    w = Window.partitionBy("did", "th").orderBy("first")
    broken = (F.lag("end").over(w) == F.col("first")) & (F.lag("leads").over(w) == F.col("leads"))
    flat = flat.withColumn("new", F.when(broken, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return flat.groupBy("did", "th", "run", "leads").agg(F.min("first").alias("first"), F.max("end").alias("end")).select("did", "th", "first", "end", "leads")


def cut(docs: DataFrame, k: int = 50, m: int = 10) -> DataFrame:
    """The rows, all columns, without the words of windows that occur earlier in the corpus.

    A row that loses all its words goes; n_chars, where there is such a column, follows the text.
    """
    did, th, cuts_at = _shared.free(docs, "did", "th", "cuts")
    later = repeats(docs.select("doc_id", "text"), k, m).where("not leads").groupBy(F.col("did").alias(did), F.col("th").alias(th)).agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias(cuts_at))
    text, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in _text.pieces(batch, most=1 << 20):
                cuts = part.column(len(part.columns) - 1)
                columns, kept = list(part.columns[:-1]), np.ones(part.num_rows, bool)
                hit = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
                if len(hit):
                    starts, _, rows = _text.spans(data, off, _text.BLANK)
                    texts = columns[text].to_pylist()
                    chars = columns[size].to_pylist() if size is not None else None
                    for i in hit.tolist():
                        body, out, at = data[off[i] : off[i + 1]].tobytes(), [], 0
                        begins = np.append(starts[rows[i] : rows[i + 1]] - off[i], len(body))
                        for c in cuts[i].as_py():
                            lo, hi = int(begins[c["first"]]), int(begins[c["end"] + k - 1])
                            out.append(body[at:lo])
                            at = max(at, hi)
                        out.append(body[at:])
                        texts[i] = b"".join(out).decode()
                        kept[i] = bool(texts[i].strip())
                        if chars and chars[i] is not None:
                            chars[i] = len(texts[i])
                    columns[text] = pa.array(texts, columns[text].type)
                    if chars:
                        columns[size] = pa.array(chars, columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1]).filter(pa.array(kept))

    keyed = docs.withColumns({did: _shared.id_column(), th: _shared.row_key()})
    joined = keyed.join(later, [did, th], "left").select(*[F.col(f"`{c}`") for c in docs.columns], cuts_at)
    return joined.mapInArrow(run, docs.schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, first_word, end_word, keep: the words that runs of repeated windows cover; keep where they occur first."""
    k = 50
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), k)
    return found.select(_shared.real_id().alias("doc_id"), F.col("first").alias("first_word"), (F.col("end") + (k - 1)).alias("end_word"), F.col("leads").alias("keep"))


OP2_SQL = r"""
WITH tok AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x20]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM tok WHERE len(w) >= 50)),
seen AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) = 1 AS leads FROM win),
rep AS (SELECT doc_id, i, leads, i - row_number() OVER (PARTITION BY doc_id, leads ORDER BY i) AS g FROM seen WHERE n > 1)
SELECT doc_id, CAST(min(i) AS INTEGER) AS first_word, CAST(max(i) + 50 AS INTEGER) AS end_word, leads AS keep FROM rep GROUP BY doc_id, leads, g
"""

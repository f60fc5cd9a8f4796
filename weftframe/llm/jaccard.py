"""N-gram Jaccard self-join by a token-group matrix.

A document's set holds the hashes of its `n` consecutive plain words (lower case, punctuation off); a text of fewer words is one
n-gram. Every document is a query; it is linked to all others whose sets have a Jaccard similarity of at least `threshold`. The result has one
row for each row of the table: the class of linked documents it belongs to, and how many documents it is linked to. Copies count, but pairs are
never written out, so the result is as long as the table.

1. One pass gives each document a set hash. Documents with equal sets collapse to the smallest id, which stands for all of them from here on.
2. What can't have a link goes. Two sets at the threshold share at least that part of either one, so a document stays only if so many of its n-grams occur in
   another row. The n-grams travel as four bytes each; hashes that meet count as occurring twice, which only keeps more.
3. Of those left, each document's n-grams are put in order of how many documents have them. Two sets at the threshold share one of the first
   size - ceil(threshold * size) + 1 of either one; those of them that occur twice are the document's keys. The keys are range-sorted, and each
   document meets the first document of its key and the one before it (as many meetings as keys, however many documents share one; a key may go
   over many partitions). Those that meet as often as similar ones must (`needed`) are put together, and the groups are the connected components.
4. Each group's sets meet in one task (those of a group of more than about `block` documents, or `most` bytes, in blocks in order of size, each pair
   of blocks in one task, but for those of sizes too far apart for the threshold). There they are split further by their smallest hash; a matrix, built and multiplied in slices of WIDTH tokens, holds each
   subgroup's token union. The overlap of a query with a union bounds its similarity to every member, so only subgroups whose bound reaches the
   threshold are opened and compared exactly. What leaves the task is a number of links for each document and one edge at most for each
   document, which tie together what is linked.

5. Pairs in different groups are those of the keys that lie in more than one. Of them those with as many keys in common as similar ones must have are compared.

All steps are exact but for the equality of 64-bit hashes: groups only decide where a pair is compared.

Defined results: a document is a distinct pair of doc_id and text; rows with one id and different texts are documents of their own, identical rows
count once and get the same result each. Null, empty or punctuation-only texts, and rows with a null doc_id, have no class and no links. class_id
is the smallest doc_id of the class, null for a document without links. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared, _text

U = np.uint64
SET = "did bigint, th bigint, lo bigint, hi bigint, size int"
WIDTH = 4096
PART = 4 << 20  # n-grams that are counted in one task


def token_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, sorted within the row, and row offsets."""
    low = _text.lower(data)
    starts, ends, rows = _text.spans(low, off, _text.NOT_WORD)
    h = _text.word_hashes(low, starts, ends)
    grams, ok = _text.ngrams(h, rows, n)
    short = np.flatnonzero((np.diff(rows) > 0) & (np.diff(rows) < n))
    for r in short:  # a text of fewer than n words: its words together
        grams[rows[r]] = _text.mix(np.array([sum(int(x) * int(p) for x, p in zip(h[rows[r] : rows[r + 1]], _text.powers(n), strict=False)) % 2**64], U))[0]
        ok[rows[r]] = True
    row, grams = _text.rows_of(rows)[ok], grams[ok]
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    row, grams = row[fresh], grams[fresh]
    return grams, np.searchsorted(row, np.arange(len(off)))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("did"), _shared.row_key().alias("th"), F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"))


def set_hashes(docs: DataFrame, n: int) -> DataFrame:
    """One row for each row of docs; lo is null where there is no set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in _text.pieces(batch, most=1 << 19):
                grams, at = token_sets(data, off, n)
                some = np.diff(at) > 0
                lo, hi = np.zeros((2, part.num_rows), U)
                if some.any():
                    starts = at[:-1][some]
                    lo[some], hi[some] = np.add.reduceat(grams, starts), np.add.reduceat(_text.mix(grams), starts)
                found = [pa.array(lo.view(np.int64), mask=~some), pa.array(hi.view(np.int64), mask=~some), pa.array(np.diff(at).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *found], ["did", "th", "lo", "hi", "size"])

    return keyed(docs).mapInArrow(run, SET)


def promising(docs: DataFrame, n: int, threshold: float, total: int) -> DataFrame:
    """th of the rows of which `threshold` of the n-grams or more occur in another row. total: n-grams of all rows."""
    parts = max(12, -(-total // PART))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, data, off in _text.pieces(batch.select(["th", "text"]), most=2 << 20):
                grams, at = token_sets(data, off, n)
                place = ((grams >> U(32)) % U(parts)).astype(np.int64)
                own = np.bincount(place * rows.num_rows + _text.rows_of(at), minlength=parts * rows.num_rows).astype(np.int32).reshape(parts, -1)
                short = grams[np.argsort(place, kind="stable")].astype(np.uint32)
                cuts = np.append(0, np.cumsum(own.sum(1)))
                ths, sizes = rows.column(0).to_numpy().tobytes(), np.diff(at).astype(np.int32).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.arange(parts, dtype=np.int32)), "piece": pa.array(np.full(parts, piece)), "ths": pa.array([ths] + [b""] * (parts - 1), pa.binary()), "sizes": pa.array([sizes] + [b""] * (parts - 1), pa.binary()),
                        "own": pa.array([v.tobytes() for v in own], pa.binary()), "grams": pa.array([short[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    }
                )
                piece += 1

    def shared(table: pa.Table) -> pa.Table:
        flat = np.concatenate([np.frombuffer(v.as_buffer(), np.uint32) for v in table.column("grams")])
        order = np.argsort(flat, kind="stable")
        same = flat[order[1:]] == flat[order[:-1]]
        often = np.zeros(len(flat), bool)
        often[order[1:][same]] = often[order[:-1][same]] = True
        at, out = 0, []
        for v in table.column("own"):
            ends = np.append(0, np.cumsum(np.frombuffer(v.as_buffer(), np.int32), dtype=np.int64))
            met = np.append(0, np.cumsum(often[at : at + ends[-1]]))[ends]
            out.append(np.diff(met).astype(np.int32).tobytes())
            at += ends[-1]
        return table.select(["piece", "ths", "sizes"]).append_column("shared", pa.array(out, pa.binary()))

    def kept(table: pa.Table) -> pa.Table:
        met = np.sum([np.frombuffer(v.as_buffer(), np.int32) for v in table.column("shared")], 0)
        ths, sizes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("ths", np.int64), ("sizes", np.int32)))
        return pa.table({"th": pa.array(ths[(sizes > 0) & (met >= threshold * sizes - 1e-6)])})

    sent = keyed(docs).where("did is not null").mapInArrow(send, "part int, piece bigint, ths binary, sizes binary, own binary, grams binary")
    met = sent.groupBy("part").applyInArrow(shared, "piece bigint, ths binary, sizes binary, shared binary")
    return met.groupBy("piece").applyInArrow(kept, "th bigint").distinct()


def prefixes(tokens: DataFrame, threshold: float) -> DataFrame:
    """th, size and keys: the first of each document's tokens, rare ones first, that another document has as well."""
    each = tokens.select("th", F.size("tokens").alias("size"), F.explode("tokens").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = each.join(often, "key").groupBy("th", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("met"))
    first = F.col("size") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-6)) + 1 - (F.col("size") - F.size("met"))
    met = met.select("th", "size", F.expr("transform(met, x -> x.key)").alias("keys"), first.cast("int").alias("first")).where("first > 0")
    return met.select("th", "size", F.slice("keys", F.lit(1), F.col("first")).alias("keys"))


def needed(x: Column, y: Column, threshold: float) -> Column:
    """The least number of keys that sets of x and y tokens at the threshold have in common.

    Beyond the prefix that ends first in the order of tokens, its set has ceil(threshold * size) - 1 tokens; all the others that they share are keys of both.
    """
    overlap = F.ceil((x + y) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6))
    return F.greatest(F.lit(1), overlap - F.ceil(F.greatest(x, y) * F.lit(threshold) - F.lit(1e-6)) + 1)


def apart(pre: DataFrame, groups: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of all similar documents in different groups, a < b."""
    own = pre.join(groups, F.col("th") == F.col("node"), "left").select("th", "size", F.coalesce("root", "th").alias("root"), F.explode("keys").alias("key"))
    several = own.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("key")
    own = _shared.stash(own.join(several, "key"), "apart", release=True)
    left, right = own.toDF("key", "a", "sa", "ra"), own.toDF("key", "b", "sb", "rb")
    met = left.join(right, "key").where("ra != rb and a < b").where(F.least("sa", "sb") >= F.greatest("sa", "sb") * F.lit(threshold) - F.lit(1e-6))
    met = met.groupBy("a", "b", "sa", "sb").agg(F.count("*").alias("n")).where(F.col("n") >= needed(F.col("sa"), F.col("sb"), threshold))
    both = met.join(tokens.toDF("a", "ta"), "a").join(tokens.toDF("b", "tb"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("n"), (F.col("sa") + F.col("sb")).alias("all"))
    return both.where(F.col("n") / (F.col("all") - F.col("n")) >= threshold).select("a", "b")


def compare(sizes: np.ndarray, tokens: list[np.ndarray], least: np.ndarray, threshold: float, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right: whether the similarity reaches the threshold; documents are in order of their smallest hash.

    The matrix of documents x tokens holds only tokens of two documents or more, as others can't overlap, and only WIDTH of them at a time.
    """
    flat = np.concatenate(tokens)
    doc = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    column = np.append(0, np.cumsum(flat[1:] != flat[:-1]))
    common = np.bincount(column) > 1
    keep = common[column]
    column, doc = (np.cumsum(common) - 1)[column[keep]], doc[keep]
    cuts = np.searchsorted(column, np.arange(0, int(common.sum()) + WIDTH, WIDTH))

    def slices() -> Iterator[np.ndarray]:
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            m = np.zeros((len(tokens), min(WIDTH, int(common.sum()) - k * WIDTH)), np.float32)
            m[doc[a:b], column[a:b] - k * WIDTH] = 1
            yield m

    key = least[right]  # subgroups: runs of the smallest hash
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    bound = np.zeros((len(left), len(starts)))
    for m in slices():
        bound += m[left] @ np.maximum.reduceat(m[right], starts).T
    own, other = sizes[left][:, None], sizes[right][None, :]
    qualifies = bound >= threshold * (own + np.minimum.reduceat(sizes[right], starts)[None, :] - bound) - 1e-6
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(right))))
    opened = np.flatnonzero(qualifies.any(0)[group])
    out = np.zeros((len(left), len(right)), bool)
    if len(opened):
        both = np.zeros((len(left), len(opened)))
        for m in slices():
            both += m[left] @ m[right[opened]].T
        out[:, opened] = (both / (own + other[:, opened] - both) >= threshold) & qualifies[:, group[opened]]
    return out


def tied(hit: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For each of size documents the first one that hits tie it to, over any number of others."""
    label = np.arange(size)
    while True:
        last = label.copy()
        label[left] = np.minimum(label[left], np.where(hit, label[right][None, :], size).min(1))
        label[right] = np.minimum(label[right], np.where(hit, label[left][:, None], size).min(0))
        label = label[label]
        if (label == last).all():
            return label


def neighbours(reps: DataFrame, counted: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of documents that share a key, two for each document and key at most; all that share one are connected. counted: n, at how many keys they met."""
    rows = reps.select(F.explode("keys").alias("key"), F.col("th").alias("node"))
    ordered = rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, lead = TaskContext.get().partitionId(), None, None
        last_key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = (batch.column(c).to_numpy() for c in (0, 1))
            if first is None:
                first, last_key, last, lead = (int(key[0]), int(node[0])), int(key[0]), int(node[0]), int(node[0])
            before_key, before = np.append(last_key, key[:-1]), np.append(last, node[:-1])
            start = np.where(key != before_key, np.arange(len(key)), -1)
            start = np.maximum.accumulate(start)
            leads = np.where(start >= 0, node[start], lead)
            same = key == before_key
            far = same & (before != leads)
            a, b = np.append(node[same], node[far]), np.append(before[same], leads[far])
            a, b = np.minimum(a, b), np.maximum(a, b)
            a, b = a[a != b], b[a != b]
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none], ["a", "b", "key", "part"])
            last_key, last, lead = int(key[-1]), int(node[-1]), int(leads[-1])
        if first is not None:  # the ends of the partition, for keys that go on in the next one
            yield pa.RecordBatch.from_pydict({"a": pa.array([first[1], last], pa.int64()), "b": pa.nulls(2, pa.int64()), "key": pa.array([first[0], last_key], pa.int64()), "part": pa.array([2 * part, 2 * part + 1], pa.int64())})

    found = _shared.stash(ordered.mapInArrow(run, "a bigint, b bigint, key bigint, part bigint"), "neighbours", release=True)
    ends = found.where("b is null")  # two rows a partition
    over = Window.partitionBy("key").orderBy("part")
    ends = ends.select("a", F.lag("a").over(over).alias("other")).where("other is not null and a != other").select(F.least("a", "other").alias("a"), F.greatest("a", "other").alias("b"))
    found = found.where("b is not null").select("a", "b").union(ends)
    return found.groupBy("a", "b").agg(F.count("*").alias("n")) if counted else found.distinct()


def blocked(member: DataFrame, block: int, most: int) -> DataFrame:
    """member (th, root, size, others) with own, the block of its group: about `block` documents and `most` bytes of n-grams at most, in order of size."""
    each = member.groupBy("root", "size").agg(F.sum(F.lit(1 / block) + F.col("size") * F.lit(8 / most)).alias("weight"))
    over = Window.partitionBy("root").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("before", F.coalesce(F.sum("weight").over(over), F.lit(0.0)))
    share = F.pmod(F.xxhash64("th"), F.lit(1 << 20)) / F.lit(1 << 20)  # of one size, by hash
    return member.join(each, ["root", "size"]).withColumn("own", F.floor(F.col("before") + F.col("weight") * share).cast("int")).drop("weight", "before")


def block_pairs(member: DataFrame, threshold: float) -> DataFrame:
    """(root, own, other), both ways and with itself: blocks whose sizes are near enough for similar sets; one must have `threshold` of the other's n-grams at least."""
    ends = member.groupBy("root", "own").agg(F.min("size").alias("small"), F.max("size").alias("large"))
    both = ends.join(ends.toDF("root", "other", "small_", "large_"), "root")
    return both.where(F.least("large", "large_") >= F.greatest("small", "small_") * F.lit(threshold) - F.lit(1e-6)).select("root", "own", "other")


def linked(docs: DataFrame, threshold: float = 0.5, n: int = 3, block: int = 512, most: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(did, th, lo, hi) of each row of docs; and (lo, hi, class_id, class_th, links) of each set with links, class_id and class_th being those of the class's first document."""
    docs = docs.select("doc_id", "text")
    sets = _shared.stash(set_hashes(docs, n), "sets", release=True)
    known = sets.where("lo is not null")
    copies = known.select("lo", "hi", "did", "th").distinct().groupBy("lo", "hi").agg(F.count("*").alias("copies"))
    reps = known.groupBy("lo", "hi").agg(F.min(F.struct("did", "th", "size")).alias("r")).join(copies, ["lo", "hi"]).select("lo", "hi", "copies", "r.*")
    reps = _shared.stash(reps, "representatives", release=True)

    total = sets.agg(F.sum("size")).first()[0] or 0
    left = _shared.stash(reps.join(promising(docs, n, threshold, total), "th").select("did", "th"), "promising", release=True)
    tokens = _shared.stash(_grams(docs, left, n), "tokens", release=True)
    pre = _shared.stash(prefixes(tokens, threshold), "prefixes", release=True)
    sizes = pre.select("th", "size")
    met = neighbours(pre, counted=True).join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b")
    groups = _shared.components(met.where(F.col("n") >= needed(F.col("sa"), F.col("sb"), threshold)))

    # blocks of large groups; each pair of blocks that may hold similar sets is one task's work
    member = reps.select("did", "th", "copies", "size").join(groups, F.col("th") == F.col("node")).drop("node")
    member = _shared.stash(blocked(member, block, most), "members", release=True)
    pair_of_blocks = tokens.join(member.join(block_pairs(member, threshold), ["root", "own"]), "th").select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "th", "copies", "tokens"
    )

    def work(key: tuple, table: pa.Table) -> pa.Table:
        th, own, copies = (table.column(c).to_numpy() for c in ("th", "own", "copies"))
        tokens = [v.values.to_numpy().view(U) for v in table.column("tokens")]
        least = np.array([t[0] for t in tokens], U)  # sorted: the smallest hash
        order = np.lexsort((th, least))
        tokens, least = [tokens[k] for k in order], least[order]
        th, own, copies = th[order], own[order], copies[order]
        _, i, j = (k.as_py() for k in key)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        count, label = np.zeros(len(th), np.int64), np.arange(len(th))
        if len(left) and len(right):
            hit = compare(np.array([len(t) for t in tokens], np.float64), tokens, least, threshold, left, right)
            if i == j:
                np.fill_diagonal(hit, False)
            np.add.at(count, left, hit @ copies[right])
            if i != j:
                np.add.at(count, right, copies[left] @ hit)
            label = tied(hit, left, right, len(th))
        some, other = count > 0, label != np.arange(len(th))
        return pa.table({"a": pa.array(np.append(th[some], th[other])), "b": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(th[label[other]])]), "n": pa.array(np.append(count[some], np.zeros(other.sum(), np.int64)))})

    within = pair_of_blocks.groupBy("root", "i", "j").applyInArrow(work, "a bigint, b bigint, n bigint")
    pairs = _shared.stash(apart(pre, groups, tokens, threshold), "pairs-apart", release=True)
    copied = reps.select(F.col("th").alias("b"), F.col("copies").alias("n"))
    across = pairs.union(pairs.select("b", "a")).join(copied, "b").select("a", "b", "n")
    found = _shared.stash(within.union(across), "links", release=True)
    result = _shared.classes(reps.withColumnsRenamed({"th": "node", "did": "id"}), found, "lo", "hi").withColumnRenamed("class_node", "class_th")
    return sets.select("did", "th", "lo", "hi"), result


def join(docs: DataFrame, threshold: float = 0.5, n: int = 3, block: int = 512, most: int = 16 << 20) -> DataFrame:
    """doc_id, class_id, links for each row."""
    each, result = linked(docs, threshold, n, block, most)
    return each.join(result, ["lo", "hi"], "left").select(F.col("did").alias("doc_id"), "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def _grams(docs: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """th and tokens, in order, of each document of left, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in _text.pieces(batch, most=1 << 20):
                grams, at = token_sets(data, off, n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))], ["th", "tokens"])

    # keyed by th alone, so that texts are sent once: did, were it a key as well, would have them sent again by th. Identical rows share it
    joined = keyed(docs).join(left.withColumnRenamed("did", "own"), "th").where(F.col("did").bitwiseXOR(F.col("own")) == 0)
    joined = joined.dropDuplicates(["th"]).select("th", "text")
    return joined.mapInArrow(run, "th bigint, tokens array<bigint>")


def drop_copies(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns, but for those that another row of their class stands for: the one with the smallest id stays.

    Identical rows stay or go together; rows with a null doc_id or without words stay.
    """
    each, result = linked(docs, threshold)
    did, th = _shared.free(docs, "did", "th")
    gone = each.join(result, ["lo", "hi"]).where("did != class_id or th != class_th").select(F.col("did").alias(did), F.col("th").alias(th)).distinct()
    keyed = docs.withColumns({did: F.col("doc_id").cast("bigint"), th: _shared.row_key()})
    return keyed.join(gone, [did, th], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents),
gram AS (
  SELECT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM tok WHERE len(w) > 0)),
sets AS (SELECT doc_id, list_sort(list(DISTINCT g)) AS s FROM gram GROUP BY doc_id),
reps AS (SELECT s, min(doc_id) AS rep, count(*) AS copies FROM sets GROUP BY s),
item AS (SELECT rep, copies, len(s) AS n, unnest(s) AS g FROM reps),
pair AS (
  SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM item a JOIN item b ON a.g = b.g AND a.rep != b.rep
  GROUP BY 1, 2 HAVING CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5),
reach(a, b) AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
class AS (SELECT a AS rep, least(a, min(b)) AS class_id FROM reach GROUP BY a),
near AS (SELECT a AS rep, sum(copies) AS links FROM pair GROUP BY a),
found AS (
  SELECT r.s, coalesce(c.class_id, r.rep) AS class_id, r.copies - 1 + coalesce(n.links, 0) AS links
  FROM reps r LEFT JOIN class c USING (rep) LEFT JOIN near n USING (rep))
SELECT d.doc_id, CASE WHEN f.links > 0 THEN f.class_id END AS class_id, CAST(coalesce(f.links, 0) AS BIGINT) AS links
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN found f ON f.s = s.s
"""

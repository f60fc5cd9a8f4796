"""A hashed maximum-entropy language model with a class-factored softmax.

Words are plain words. The `listed` most frequent words of the whole corpus are outcomes of their own, all others share `rest` hashed
outcomes; an outcome lies in one of `classes` classes of `width`. P(word | context) = P(class | context) P(outcome | class, context), each factor a
softmax over summed weights of hashed features: the previous word, the previous two, and the word before the previous (a skip). A word that isn't
listed has its outcome's probability times the share that its slot has in the outcome over the whole corpus. Slots are the first bits of the word's hash; there are
two to four for each distinct word, but 2 ** `slot_bits` at most. Words that share a slot, by chance or in vocabularies beyond that, have the parts of its
probability that their counts give them: those of the KEPT most frequent ones travel with the model, the others are joined. What has no count shares that of one word. Probabilities of all slots and listed words add up to 1.

Training passes over every document once, in `rounds` rounds that each take the documents of one hash. A round's tasks start from the shared weights and
add up, for each feature and outcome, how often it was met (O) and how often the model expected it (E); O - E is the gradient of the log-likelihood, and
`rate` / (E + `prior`) its step. The expectations are whole numbers of 1/SCALE, so their sums don't depend on how rows lie in tasks or in which order
tasks end: any partitioning gives the same model. What is gathered grows with the tasks and, for words, with the corpus; the weights, and
what travels with the code, have the size that the parameters give them. Scoring is one pass without a shuffle, in sparse numpy batches.

Defined results: a null, empty or punctuation-only text has 0 words, null log_prob and null perplexity; a null doc_id is passed on; repeated rows train
as often as they occur and score the same; of equally frequent words those with smaller hashes are listed; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text

U = np.uint64
_K = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
FEATURES = len(_K)
LIST_BITS = 20
SCALE = 4096
BATCH = 1 << 15
KEPT = 1 << 18
EXACT = 1 << 32


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _text.lower(data)
    starts, ends, rows = _text.spans(low, off, _text.NOT_WORD)
    return _text.word_hashes(low, starts, ends), rows


def slot_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


@dataclass
class Vocabulary:
    words: np.ndarray  # hashes of the listed words, the most frequent first
    rest: int
    width: int
    share: np.ndarray  # logarithm of each slot's share of its outcome

    @property
    def bits(self) -> int:
        return len(self.share).bit_length() - 1

    @property
    def first(self) -> int:
        """The first outcome that isn't a listed word."""
        return -(-len(self.words) // self.width) * self.width

    @property
    def classes(self) -> int:
        return self.first // self.width + -(-self.rest // self.width)

    def places(self) -> np.ndarray:
        """By the first bits of a hash: 1 + the place of the listed word there, 0 for none."""
        out = np.zeros(1 << LIST_BITS, np.int32)
        out[slot_of(self.words[::-1], LIST_BITS)] = np.arange(len(self.words), 0, -1)
        return out

    def outcomes(self, h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outcome of each word, and the logarithm of its share of it."""
        at = places[slot_of(h, LIST_BITS)]
        known = at > 0
        known[known] = self.words[at[known] - 1] == h[known]
        slot = slot_of(h, self.bits)
        return np.where(known, at - 1, self.first + slot % self.rest), np.where(known, 0.0, self.share[slot])


def features(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """FEATURES x words: 64-bit hashes of what comes before each word in its row."""
    one, two = np.zeros_like(h), np.zeros_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    starts = rows[:-1][np.diff(rows) > 0]
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[second < len(h)]] = 0
    return np.stack([_text.mix(one + _K[0]), _text.mix(one * _K[1] + two), _text.mix(two + _K[2])])


class Net:
    """weights: rows of features for classes, then those for outcomes in a class; the last of each part are biases without a feature."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray | None = None, bits: int = 14):
        self.v = vocabulary
        self.wide = max(vocabulary.classes, vocabulary.width)
        self.w = np.zeros((2 * (1 << bits) + 1 + vocabulary.classes, self.wide), np.float32) if weights is None else weights
        self.size = (len(self.w) - 1 - vocabulary.classes) // 2
        self.bits = self.size.bit_length() - 1
        self.second = self.size + 1  # where the second part begins
        self.crowded: DataFrame | None = None  # words that share a slot

    def parts(self, f: np.ndarray, outcome: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, int, np.ndarray]]:
        """For either factor: the rows of the features, that of the bias, the number of choices and the one taken."""
        cls, own = outcome // self.v.width, outcome % self.v.width
        yield [slot_of(x, self.bits) for x in f], np.full(len(cls), self.size), self.v.classes, cls
        salt = (cls.astype(U) + U(1)) * _K[0]
        yield [self.second + slot_of((x ^ salt) * _K[1], self.bits) for x in f], self.second + self.size + cls, self.v.width, own

    def forward(self, rows: list[np.ndarray], bias: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the choices times their sum, and that sum; each word's by itself."""
        z = self.w.take(bias, 0)
        one = np.empty_like(z)
        for r in rows:
            z += self.w.take(r, 0, out=one, mode="clip")
        p = np.exp(np.clip(z[:, :n], -60, 60))
        return p, p.sum(1)

    def log_prob(self, f: np.ndarray, outcome: np.ndarray) -> np.ndarray:
        out = np.zeros(len(outcome))
        for rows, bias, n, target in self.parts(f, outcome):
            p, total = self.forward(rows, bias, n)
            out += np.log(p[np.arange(len(target)), target].astype(np.float64)) - np.log(total.astype(np.float64))
        return out

    def add(self, f: np.ndarray, outcome: np.ndarray, met: np.ndarray, expected: np.ndarray) -> None:
        """Adds how often each feature's row (met: choices x rows) was met with each choice, and SCALE times how often that was expected."""
        for part, (rows, bias, n, target) in enumerate(self.parts(f, outcome)):
            p, total = self.forward(rows, bias, n)
            q = np.rint(p * (SCALE / total)[:, None]).T.astype(np.float64)
            base = part * self.second
            for r in rows:
                at = r - base
                met[:n, base : base + self.size] += np.bincount(target * self.size + at, minlength=n * self.size).reshape(n, -1)
                for k in range(n):
                    expected[k, base : base + self.size] += np.bincount(at, q[k], self.size)

    def step(self, met: np.ndarray, expected: np.ndarray, rate: float, prior: float) -> None:
        """met and expected: rows x choices."""
        self.w = self.w + np.clip(rate * (met - expected) / (expected + prior), -1, 1).astype(np.float32)


def batches_of(f: np.ndarray, outcome: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(outcome), BATCH):
        yield f[:, at : at + BATCH], outcome[at : at + BATCH]


def counted(docs: DataFrame) -> DataFrame:
    """h and n: each word of all documents, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, off in _text.pieces(batch, most=4 << 20):
                h, n = np.unique(words_of(data, off)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return _shared.stash(docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame, listed: int, rest: int, width: int, slot_bits: int) -> tuple[Vocabulary, np.ndarray]:
    """The words' outcomes, and how often each outcome occurs."""
    top = counts.orderBy(F.desc("n"), "h").limit(listed).collect()
    words = np.array([r["h"] for r in top], np.int64).view(U)
    distinct = counts.count()
    bits = min(slot_bits, max(distinct, rest).bit_length() + 1)
    others = counts.where(~F.col("h").isin(words.view(np.int64).tolist())) if len(words) else counts
    found = others.groupBy(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("slot")).agg(F.sum("n").alias("n")).toArrow()  # a row for each slot at most
    n = np.zeros(1 << bits)
    n[found["slot"].to_numpy()] = found["n"].to_numpy()
    group = np.arange(len(n)) % rest
    empty = np.bincount(group, n == 0, rest)
    n[n == 0] = 1 / empty[group[n == 0]]  # together one word in each outcome
    whole = np.bincount(group, n, rest)
    vocab = Vocabulary(words, rest, width, (np.log(n) - np.log(whole)[group]).astype(np.float32))
    often = np.full(vocab.classes * width, 1e-3)  # what no word has
    often[: len(words)] = [r["n"] for r in top]
    often[vocab.first : vocab.first + rest] = whole
    return vocab, often.reshape(vocab.classes, width)


def crowded(counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """h, n and slot of each word that shares its slot; c: EXACT times the logarithm of its part of it."""
    others = counts.where(~F.col("h").isin(vocab.words.view(np.int64).tolist())) if len(vocab.words) else counts
    others = others.withColumn("slot", F.shiftrightunsigned("h", 64 - vocab.bits).cast("int"))
    taken = others.groupBy("slot").agg(F.sum("n").alias("all"), F.count("*").alias("k")).where("k > 1")
    part = F.round(F.log(F.col("n") / F.col("all")) * F.lit(float(EXACT))).cast("bigint")
    return _shared.stash(others.join(taken, "slot").select("h", "n", "slot", part.alias("c")), "shared-slots")


def train(docs: DataFrame, listed: int = 384, rest: int = 192, width: int = 24, slot_bits: int = 22, bits: int = 14, rounds: int = 3, rate: float = 0.4, prior: float = 2.0) -> Net:
    """bits: 2 ** bits rows of weights for the features of either factor."""
    spark = docs.sparkSession
    counts = counted(docs)
    vocab, often = vocabulary(counts, listed, rest, width, slot_bits)
    net = Net(vocab, bits=bits)
    net.crowded = crowded(counts, vocab)
    # the frequencies of outcomes are where training starts
    net.w[net.size, : vocab.classes] = np.log(often.sum(1) / often.sum())
    net.w[net.second + net.size :, :width] = np.log(often / often.sum(1, keepdims=True))
    plain = (vocab.words, rest, width, vocab.share)
    names = [f"w{i}" for i in range(net.wide)]
    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds))
    for r in range(rounds):
        start = spark.sparkContext.broadcast((*plain, net.w))  # arrays, as large as the parameters say

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            *plain, w = start.value
            v = Vocabulary(*plain)
            own, places = Net(v, w), v.places()
            met, expected = np.zeros((own.wide, len(w)), np.int64), np.zeros((own.wide, len(w)))
            for batch in batches:
                for _, data, off in _text.pieces(batch, most=1 << 20):
                    h, rows = words_of(data, off)
                    for f, o in batches_of(features(h, rows), v.outcomes(h, places)[0]):
                        own.add(f, o, met, expected)
            some = np.flatnonzero(met.any(0))
            for kind, table in enumerate((met, expected)):
                for at in range(0, len(some), 4096):
                    rows = some[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(2 * rows + kind), *(pa.array(c.astype(np.int64)) for c in table[:, rows])], ["row", *names])

        sums = docs.where(part == r).select("text").mapInArrow(run, "row bigint, " + ", ".join(f"{c} bigint" for c in names))
        found = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        both = np.zeros((2 * len(net.w), net.wide))
        if len(found):
            both[found["row"].to_numpy()] = np.stack([found[c].to_numpy() for c in names], 1)
        net.step(both[0::2], both[1::2] / SCALE, rate, prior)
        start.unpersist()
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, n_words, log_prob (the mean of a word's, in nats), perplexity; to 4 decimals."""
    v = net.v
    spark = docs.sparkSession
    top_h, top_c, slots = np.zeros(0, U), np.zeros(0, np.int64), None
    if net.crowded is not None:
        top = net.crowded.orderBy(F.desc("n"), "h").limit(KEPT).select("h", "c").toArrow()
        top_h, top_c = top["h"].to_numpy().view(U), top["c"].to_numpy()
        order = np.argsort(top_h)
        top_h, top_c = top_h[order], top_c[order]
        if len(top_h) == KEPT:
            slots = np.zeros(len(v.share), bool)
            slots[net.crowded.select("slot").distinct().toArrow()["slot"].to_numpy()] = True
    shared = spark.sparkContext.broadcast((v.words, v.rest, v.width, v.share, net.w, top_h, top_c, slots))  # arrays, as large as the parameters say

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *plain, w, top_h, top_c, slots = shared.value
        v = Vocabulary(*plain)
        own, places = Net(v, w), v.places()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part, data, off in _text.pieces(batch, most=1 << 20):
                h, rows = words_of(data, off)
                outcome, share = v.outcomes(h, places)
                found = [own.log_prob(f, o) for f, o in batches_of(features(h, rows), outcome)]
                each = (np.concatenate(found) if found else np.zeros(0)) + share
                at = np.searchsorted(top_h, h)
                hit = np.append(top_h, U(0))[at] == h if len(top_h) else np.zeros(len(h), bool)
                hit &= at < len(top_h)
                each[hit] += top_c[at[hit]] / EXACT
                n = np.diff(rows)
                total = np.full(len(n), np.nan)
                if len(each):
                    total[n > 0] = np.add.reduceat(each, rows[:-1][n > 0])
                left = np.flatnonzero(slots[slot_of(h, v.bits)] & ~hit & (outcome >= v.first)) if slots is not None else np.zeros(0, np.int64)
                others = pa.ListArray.from_arrays(pa.array(np.searchsorted(left, rows).astype(np.int32)), pa.array(h[left].view(np.int64)))
                ids = pa.array(np.arange(row, row + len(n)))
                row += len(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(total, from_pandas=True), ids, others], ["doc_id", "n_words", "total", "row", "others"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, total double, row bigint, others array<bigint>")
    total = F.col("total")
    if slots is not None:
        scored = _shared.stash(scored, "scored")
        exact = scored.select("row", F.explode("others").alias("h")).join(net.crowded.select("h", "c"), "h").groupBy("row").agg(F.sum("c").alias("c"))
        scored = scored.drop("others").join(exact, "row", "left")
        total = total + F.coalesce(F.col("c"), F.lit(0)) / F.lit(float(EXACT))
    mean = total / F.col("n_words")
    return scored.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round(mean, 4)).alias("log_prob"), F.when(F.col("n_words") > 0, F.round(F.exp(-mean), 4)).alias("perplexity"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs))

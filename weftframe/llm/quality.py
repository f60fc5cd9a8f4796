"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are the presence of hashed words and of the first bytes of longer words, of its language and its source (hashed as well), and statistics of its bytes. The score
is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pairwise sum is computed in linear time as half of
sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2). There are two machines, for quality and for toxicity. They are fitted on a bounded sample of
labelled rows (`max_train`). All its features take part: those of language and source always, and of the hashed words those for which the loss falls faster than a
penalty on their weight rises (`penalty` / sqrt(rows)); others would get no weight, and whether they should is asked again of all of them after each
fit. Scoring is one pass over the texts without a shuffle; what travels with it is as large as the model, whatever the corpus.

Defined results: a null, empty or blank text has null scores and is not kept. Where the labels hold one class only, or none, that
score is null and doesn't decide. Labels without a document, and null labels, don't take part. A null lang or source has no feature. Rows that share
everything get the same scores; a null doc_id is passed on; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text

BITS = 22
HEADS = ("quality", "toxic")
STATS = 9
STEM = 5

_KIND = np.zeros((256, 5), np.float32)  # upper case, digits, punctuation, not ASCII, line ends
for _b in range(256):
    _KIND[_b] = [65 <= _b <= 90, 48 <= _b <= 57, 32 < _b < 127 and not chr(_b).isalnum(), _b >= 128, _b == 10]


def bucket(word: str) -> int:
    return _text.hash_word(word) >> (64 - BITS)


def extract(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of each distinct hashed word or beginning of one; the rows' statistics; the rows' words."""
    n = len(off) - 1
    low = _text.lower(data)
    starts, ends, rows = _text.spans(low, off, _text.NOT_WORD)
    words = np.diff(rows)
    row = _text.rows_of(rows) << BITS
    whole = np.unique(row | (_text.word_hashes(low, starts, ends) >> _text.U(64 - BITS)).astype(np.int64))
    distinct = np.bincount(whole >> BITS, minlength=n)
    long = ends - starts > STEM
    stems = _text.mix(_text.word_hashes(low, starts[long], starts[long] + STEM)) >> _text.U(64 - BITS)  # another bucket than the word that equals it
    pairs = np.unique(np.append(whole, row[long] | stems.astype(np.int64)))
    row, hashed = pairs >> BITS, pairs & ((1 << BITS) - 1)
    stats = np.zeros((n, STATS), np.float32)
    size = np.maximum(np.diff(off), 1)
    for k in range(5):
        total = np.append(0, np.cumsum(_KIND[:, k][data], dtype=np.float64))
        stats[:, k] = (total[off[1:]] - total[off[:-1]]) / size
    some = np.maximum(words, 1)
    lens = np.append(0, np.cumsum(ends - starts))
    stats[:, 5] = (lens[rows[1:]] - lens[rows[:-1]]) / some
    stats[:, 6] = np.log1p(words)
    stats[:, 7] = distinct / some
    stats[:, 8] = np.sqrt(stats[:, 2])
    return row, hashed, stats, words


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # features
    factors: np.ndarray  # features x rank


@dataclass
class Model:
    buckets: np.ndarray  # the hashed words' buckets, ascending; features after the statistics
    mean: np.ndarray
    scale: np.ndarray
    heads: dict[str, Machine]

    def table(self) -> np.ndarray:
        """Feature + 1 of each bucket, 0 for none."""
        out = np.zeros(1 << BITS, np.int32)
        out[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return out

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)

    def score(self, head: str, stats: np.ndarray, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Log-odds; row (ascending) and feature (from 0) list the words that are present."""
        m, n = self.heads[head], len(stats)
        x = self.standard(stats)
        total = m.bias + x @ m.linear[:STATS] + np.bincount(row, m.linear[STATS + feature], n)
        for f in range(m.factors.shape[1]):
            v = m.factors[:, f]
            s = x @ v[:STATS] + np.bincount(row, v[STATS + feature], n)
            q = (x * x) @ (v[:STATS] ** 2) + np.bincount(row, v[STATS + feature] ** 2, n)
            total += 0.5 * (s * s - q)
        return total


def train(x: np.ndarray, y: np.ndarray, rank: int, rounds: int = 150, rate: float = 0.05, decay: float = 2e-3) -> Machine:
    """Logistic loss, both classes weighing the same; Adam over all rows, with the words' weights shrunk towards 0."""
    rng = np.random.default_rng(5)
    n, d = x.shape
    share = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))).astype(np.float32)
    sign = np.where(y > 0, 1.0, -1.0).astype(np.float32)
    params = [np.zeros(1, np.float32), np.zeros(d, np.float32), (rng.standard_normal((d, rank)) * 0.01).astype(np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    square = x * x
    for t in range(1, rounds + 1):
        b, w, v = params
        s = x @ v
        z = b[0] + x @ w + 0.5 * (s * s - square @ (v * v)).sum(1)
        g = -sign * share / (1 + np.exp(np.clip(sign * z, -30, 30)))
        gv = x.T @ (g[:, None] * s) - v * (square.T @ g)[:, None] + decay * v
        grads = [np.array([g.sum()], np.float32), x.T @ g + decay * 0.5 * np.sign(w), gv]
        for p, a, c, gr in zip(params, first, second, grads, strict=True):
            a += 0.1 * (gr - a)
            c += 0.001 * (gr * gr - c)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-6)
    return Machine(float(params[0][0]), params[1], params[2])


def fitted(row: np.ndarray, feature: np.ndarray, size: int, always: np.ndarray, stats: np.ndarray, y: np.ndarray, rank: int, penalty: float) -> tuple[np.ndarray, Machine]:
    """The features that get a weight, ascending, and the machine over the statistics and them. row and feature (of `size`) list what is present; y is 0 or 1."""
    n = len(y)
    sign, share = np.where(y > 0, 1.0, -1.0), np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    active, z = always, np.zeros(n)
    for _ in range(4):
        gradient = np.bincount(feature, (share / (1 + np.exp(np.clip(sign * z, -30, 30))) * sign)[row], size)
        more = np.union1d(active, np.flatnonzero(np.abs(gradient) > penalty / np.sqrt(n)))
        if len(more) == len(active) and z.any():
            break
        active = more
        place = np.full(size, -1)
        place[active] = np.arange(len(active))
        own = place[feature]
        x = np.zeros((n, STATS + len(active)), np.float32)
        x[:, :STATS] = stats
        x[row[own >= 0], STATS + own[own >= 0]] = 1
        machine = train(x, y, rank)
        s = x @ machine.factors
        z = machine.bias + x @ machine.linear + 0.5 * (s * s - (x * x) @ (machine.factors**2)).sum(1)
    return active, machine


def _columns(docs: DataFrame) -> list:
    extra = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return [F.col("doc_id").cast("bigint").alias("doc_id"), "text", *extra]


def _meta(part: pa.RecordBatch, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    row, hashed = [], []
    for name in ("lang", "source"):
        for i, v in enumerate(part.column(part.schema.get_field_index(name)).to_pylist()):
            if v is not None:
                key = f"{name}={v}"
                if key not in cache:
                    cache[key] = bucket(key)
                row.append(i)
                hashed.append(cache[key])
    return np.array(row, np.int64), np.array(hashed, np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, rank: int = 4, penalty: float = 0.46) -> Model | None:
    """A model from max_train labelled documents at most, picked by a hash of their ids, then of their rows."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int"), F.col("toxic").cast("int")).distinct()
    total = known.count()
    if not total:
        return None
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < min(1.0, max_train / total) * float(1 << 30)
    # about max_train short rows: small enough to broadcast, whatever the size of the tables
    rows = docs.select(*_columns(docs), F.xxhash64("doc_id", "text").alias("key")).join(F.broadcast(known.where(part)), "doc_id").where("text is not null")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            for piece, data, off in _text.pieces(batch, most=1 << 20):
                row, hashed, stats, words = extract(data, off)
                lists = [(row, hashed), _meta(piece, cache)]
                packed = []
                for r, h in lists:
                    order = np.lexsort((h, r))
                    ends = np.searchsorted(r[order], np.arange(len(off)))
                    h = h[order].astype(np.int32)
                    packed.append(pa.array([h[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()))
                own = [piece.column(piece.schema.get_field_index(c)) for c in ("key", "doc_id", "quality", "toxic")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([s.tobytes() for s in stats], pa.binary()), *packed], ["key", "doc_id", "quality", "toxic", "stats", "words", "meta"]).filter(pa.array(words > 0))

    found = rows.mapInArrow(featured, "key bigint, doc_id bigint, quality int, toxic int, stats binary, words binary, meta binary")
    found = found.orderBy("key", "doc_id", "quality", "toxic", "words").limit(max_train).toArrow()
    if not len(found):
        return None
    stats = np.stack([np.frombuffer(v, np.float32) for v in found["stats"].to_pylist()])
    lists = [[np.frombuffer(v, np.int32) for v in found[c].to_pylist()] for c in ("words", "meta")]
    row = np.concatenate([np.repeat(np.arange(len(v)), [len(w) for w in v]) for v in lists])
    uniq, feature = np.unique(np.concatenate([w for v in lists for w in v]).astype(np.int64), return_inverse=True)
    row, feature = np.unique(np.stack([row, feature]), axis=1) if len(row) else (row, feature)
    always = np.unique(np.searchsorted(uniq, np.concatenate(lists[1]).astype(np.int64)))
    model = Model(uniq, stats.mean(0), stats.std(0) + 1e-4, {})
    machines = {}
    for h in HEADS:
        y = np.array([-1 if v is None else int(v > 0) for v in found[h].to_pylist()])
        if (y == 0).any() and (y == 1).any():
            there = y >= 0
            place = np.cumsum(there) - 1
            mine = there[row]
            machines[h] = fitted(place[row[mine]], feature[mine], len(uniq), always, model.standard(stats)[there], y[there], rank, penalty)
    used = np.unique(np.concatenate([a for a, _ in machines.values()])) if machines else np.zeros(0, np.int64)
    model.buckets = uniq[used]
    for h, (active, m) in machines.items():  # both over the same features
        at = STATS + np.searchsorted(used, active)
        linear, factors = np.zeros(STATS + len(used), np.float32), np.zeros((STATS + len(used), rank), np.float32)
        linear[:STATS], factors[:STATS] = m.linear[:STATS], m.factors[:STATS]
        linear[at], factors[at] = m.linear[STATS:], m.factors[STATS:]
        model.heads[h] = Machine(m.bias, linear, factors)
    return model


def score(docs: DataFrame, model: Model | None, keep_quality: float = 0.5, drop_toxic: float = 0.5) -> DataFrame:
    """doc_id, quality and toxicity (probabilities to 4 decimals), keep: good enough and not toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = model.table() if model else None, {}
        for batch in batches:
            for piece, data, off in _text.pieces(batch, most=1 << 20):
                row, hashed, stats, words = extract(data, off)
                found = {}
                if model:
                    more = _meta(piece, cache)
                    row, feature = np.append(row, more[0]), table[np.append(hashed, more[1])].astype(np.int64) - 1
                    row, feature = row[feature >= 0], feature[feature >= 0]
                    found = {h: (1 / (1 + np.exp(-np.clip(model.score(h, stats, row, feature), -30, 30)))).round(4) for h in model.heads}
                keep = words > 0
                if "quality" in found:
                    keep = keep & (found["quality"] >= keep_quality)
                if "toxic" in found:
                    keep = keep & (found["toxic"] < drop_toxic)
                none = np.full(len(words), np.nan)
                cols = [pa.array(np.where(words > 0, found.get(h, none), np.nan), pa.float64(), from_pandas=True) for h in HEADS]
                yield pa.RecordBatch.from_arrays([piece.column(0), *cols, pa.array(keep)], ["doc_id", "quality", "toxicity", "keep"])

    return docs.select(*_columns(docs)).mapInArrow(run, "doc_id bigint, quality double, toxicity double, keep boolean")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

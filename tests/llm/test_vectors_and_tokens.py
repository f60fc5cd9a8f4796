import math

import numpy as np
import pytest

from weftframe.llm import embeddings, token_counts

from .helpers import corpus, rows, ugly_rows, with_clashes

VECTORS = "vec_id bigint, embedding array<float>"


def brute(data, threshold=0.9):
    """(vec_id, class_id, links) of each row; data: (vec_id, vector)."""

    def sound(i, v):
        return i is not None and v is not None and all(e is not None and math.isfinite(e) for e in v) and any(v)

    seen = {}
    for i, v in data:
        if sound(i, v):
            seen.setdefault((i, tuple(v)), len(seen))
    keys = list(seen)
    root, links = list(range(len(keys))), [0] * len(keys)
    for a in range(len(keys)):
        for b in range(a):
            x, y = (np.array(keys[k][1], float) for k in (a, b))
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold - 1e-9:
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for k, (i, _) in enumerate(keys):
        least[root[k]] = min(i, least.get(root[k], i))
    out = []
    for i, v in data:
        k = seen[i, tuple(v)] if sound(i, v) else None
        out.append((i, None, 0) if k is None or not links[k] else (i, least[root[k]], links[k]))
    return sorted(out, key=repr)


def test_recall_and_precision(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((150, 64))
    near = [b + rng.standard_normal(64) * scale for b in base[:100] for scale in (0.2, 0.35, 0.45)]
    x = np.concatenate([base, near]).astype(np.float32).astype(float)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = rows(embeddings.near(spark.createDataFrame(data, VECTORS))), brute(data)
    have, all_ = sum(r[2] for r in got), sum(r[2] for r in want)
    assert all_ > 300 and 0.9 * all_ <= have
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))


def test_every_link_counts_once_whatever_the_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((4, 16))
    data = [(i, (base[i % 4] + rng.standard_normal(16) * 0.1).astype(np.float32).tolist()) for i in range(160)]
    data += [(1000 + i, data[i % 3][1]) for i in range(9)]
    df, want = spark.createDataFrame(data, VECTORS), brute(data)
    got = rows(embeddings.near(df))
    assert got == rows(embeddings.near(df, block=12))
    assert sum(r[2] for r in got) >= 0.97 * sum(r[2] for r in want) and all(g[2] <= w[2] for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("dim", [1, 5])
def test_odd_vectors(spark, dim):
    one = [1.0] + [0.0] * (dim - 1)
    data = [(1, one), (1, one), (2, one), (3, None), (None, one), (4, [0.0] * dim), (5, [float("nan")] + one[1:]), (6, [float("inf")] + one[1:]), (7, [1.0] * (dim + 1)), (8, [])]
    data += [(9, [None] + one[1:]), (10, [-1.0] + one[1:]), (11, [2.0] + one[1:]), (12, [1.0] * (dim + 1)), (13, [1.0] * dim + [1.25])]
    df = with_clashes(spark.createDataFrame(data, VECTORS))
    got = rows(embeddings.near(df))
    assert got == brute(data)  # in either number of elements
    assert {r[0]: r[1] for r in got}[13] == 7
    assert embeddings.near(df.limit(0)).count() == 0


def test_copies_do_not_multiply_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(2000)], VECTORS)
    assert rows(embeddings.near(df)) == sorted(((i, 0, 1999) for i in range(2000)), key=repr)


def test_decoding_finds_all_caps():
    caps = embeddings.Caps(10, 9, 2, 0.45)
    x = np.random.default_rng(0).standard_normal((20, 10)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for turn in range(2):
        first, second = caps.scores(x, turn)
        best = first.max(1) + second.max(1)
        want += [(r, (turn * 9 + a) * 9 + b) for r in range(20) for a in range(9) for b in range(9) if first[r, a] + second[r, b] >= min(0.45, best[r])]
    row, code = caps.decode(x)
    assert list(zip(row.tolist(), code.tolist(), strict=True)) == sorted(want) and want


PIECES = {"▁a": -1.0, "▁": -3.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁ab": -4.0, "bab": -2.2, "é": -1.0}


def viterbi(word, pieces):
    """(best score, fewest tokens) over all cuts, without a trie."""
    s = token_counts.MARK + word
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(s)
    for end in range(1, len(s) + 1):
        width = len(s[end - 1].encode("utf-8", "surrogatepass"))
        choices = [(best[end - 1][0] + token_counts.UNSEEN * width, best[end - 1][1] + width)]
        choices += [(best[a][0] + pieces[s[a:end]], best[a][1] + 1) for a in range(end) if s[a:end] in pieces]
        best[end] = max(choices, key=lambda c: (c[0], -c[1]))
    return best[-1][1]


def test_trie_equals_plain_viterbi(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abéx中"), rng.integers(1, 12))) for _ in range(400)]
    trie = token_counts.Trie(PIECES)
    trie.insert(set(words[:200]))
    trie.insert(set(words[200:]) - set(words[:200]))
    assert trie.counts == {w: viterbi(w, PIECES) for w in words}
    assert len(trie.score) == len({(token_counts.MARK + w)[:n] for w in words for n in range(len(w) + 2)})  # a node for each prefix


def test_counts_of_odd_rows(spark):
    docs = with_clashes(corpus(spark, ugly_rows()))
    want = sorted(((i, len((t or "").split()), sum(viterbi(w, PIECES) for w in (t or "").split() if len(w) < 1000)) for i, t, *_ in ugly_rows() if i not in (5, 12)), key=repr)
    got = rows(token_counts.count_tokens(docs, PIECES, most_words=50))
    assert [r for r in got if r[0] not in (5, 12)] == want and len(got) == docs.count()
    assert token_counts.count_tokens(corpus(spark, []), PIECES).count() == 0


def test_query_on_a_public_vocabulary(spark):
    d = "/root/testdata/sf0.001"
    pieces = token_counts.load_pieces("/opt/tokenizers/piece_bpe_32k.model")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.op8_token_counts(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").limit(12).collect()
    assert all(got[r["doc_id"]] == sum(viterbi(w, pieces) for w in r["text"].split()) for r in docs)

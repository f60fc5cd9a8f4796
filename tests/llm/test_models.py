"""Language identification, the quality classifier and the language model: accuracy on rows held out, and odd rows."""

import math
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np

from weftframe.llm import _text, language_id, language_model, quality

from .helpers import WORDS, corpus, prose, rows, ugly_rows, with_clashes

LABELS = "doc_id bigint, quality int, toxic int"


def languages(seed, n):
    return [(i, prose(seed + i, 20 + i % 30, lang), lang) for i, lang in ((i, sorted(WORDS)[i % 3]) for i in range(n))]


def test_language_id_on_held_out_rows(spark):
    model = language_id.fit(corpus(spark, languages(0, 90)))
    test = languages(5000, 60)
    got = {r["doc_id"]: r for r in language_id.identify(corpus(spark, test), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in test) >= 58
    assert sum(got[i]["ambiguous"] for i, _, _ in test) <= 2


def test_language_id_rejects_what_is_no_language_it_knows(spark):
    model = language_id.fit(corpus(spark, languages(0, 400)), max_train=400)
    rng = random.Random(5)
    words = {
        "mixed": lambda: prose(rng.randrange(10**6), 40, "en").split() + prose(rng.randrange(10**6), 40, "de").split(),
        "letters": lambda: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)],
        "cyrillic": lambda: ["".join(chr(rng.randrange(0x430, 0x450)) for _ in range(6)) for _ in range(60)],
        "italian": lambda: rng.choices("il che di non una sono con per anche più come questo della quando città giorno uomo casa strada".split(), k=60),
    }
    odd = corpus(spark, [(i, " ".join(make())) for i, make in enumerate(f for f in words.values() for _ in range(25))])
    gone = {r["doc_id"]: r["ambiguous"] for r in language_id.identify(odd, model).collect()}
    for at, kind in enumerate(words):
        assert sum(gone[i] for i in range(25 * at, 25 * at + 25)) >= 23, kind
    clean = corpus(spark, languages(9000, 200))
    assert language_id.identify(clean, model).where("ambiguous").count() <= 10
    assert language_id.keep_clear(corpus(spark, languages(0, 400)).union(odd.withColumn("lang", odd["lang"].substr(9, 1)).replace("", None, ["lang"])), 400).where("lang is null").count() <= 8


def gram_counts(text):
    """Square roots of the shares of the hashed grams of one text, by a plain loop."""
    low = (_text.plain_text(text) + " ").encode("latin-1") if _text.plain_text(text) else b""
    out = [0.0] * language_id.SIZE
    for i in range(len(low) - 1):
        out[((low[i] * 257 + low[i + 1]) * 2654435761 % 2**32) >> 20] += 1
    for i in range(len(low) - 2):
        out[(((low[i] * 257 + low[i + 1]) * 263 + low[i + 2] + (1 << 20)) * 2654435761 % 2**32) >> 20] += 1
    return [math.sqrt(v / sum(out)) for v in out] if any(b > 57 for b in low) else [0.0] * language_id.SIZE


def decoded(model, text):
    """Language and loss of one text, by plain loops over classes and bits."""
    x = gram_counts(text)
    if not any(x):
        return None, None
    f = [sum(v * float(model.weights[k, b]) for k, v in enumerate(x) if v) + float(model.bias[b]) for b in range(model.codes.shape[1])]
    losses = [sum(t * math.log1p(math.exp(-c * v)) for t, c, v in zip(trust, code, f, strict=True)) for trust, code in zip(model.trust, model.codes, strict=True)]
    return model.langs[losses.index(min(losses))], min(losses)


NEIGHBOURS = ["a", "maison matin", "", "haus morgen", "b", "a", "123 456", "the", "é", "ünïcödé", "a b", prose(4, 3000, "fr"), "x", "the river"]


def test_language_id_equals_a_plain_loop(spark):
    model = language_id.fit(corpus(spark, languages(0, 90)))
    texts = NEIGHBOURS + [t for _, t, _ in languages(7000, 20)]
    got = {r["doc_id"]: r for r in language_id.identify(corpus(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        lang, loss = decoded(model, t)
        assert got[i]["lang_pred"] == lang
        assert loss is None or math.isclose(got[i]["loss"], loss, abs_tol=2e-6)


def test_language_id_does_not_depend_on_the_rows_beside(spark):
    model = language_id.fit(corpus(spark, languages(0, 90)))
    encoded = [t.encode() for t in NEIGHBOURS]

    def at_once(rows_):
        off = np.append(0, np.cumsum([len(b) for b in rows_]))
        return list(zip(*(v.tolist() for v in language_id.judged(model, np.frombuffer(b"".join(rows_), np.uint8), off, 0.02)), strict=True))

    alone = [repr(at_once([b])[0]) for b in encoded]
    for seed in range(5):
        order = random.Random(seed).sample(range(len(encoded)), len(encoded))
        assert [repr(r) for r in at_once([encoded[k] for k in order])] == [alone[k] for k in order]


def test_pieces_bound_rows_as_well_as_bytes():
    batch = language_id.pa.RecordBatch.from_pydict({"text": ["abc"] * 10_000})
    assert max(p.num_rows for p, _, _ in _text.pieces(batch, rows=language_id.ROWS)) == language_id.ROWS
    assert sum(p.num_rows for p, _, _ in _text.pieces(batch, rows=language_id.ROWS)) == 10_000


def test_codewords_are_far_apart():
    for k in (2, 3, 4, 10):
        m = language_id.codewords(k)
        assert min((m[i] != m[j]).sum() for i in range(k) for j in range(i)) >= 5
        assert (np.abs(m.sum(0)) < k).all()


def test_language_id_odd_rows(spark):
    docs = with_clashes(corpus(spark, ugly_rows() + languages(100, 60)))
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    assert len(got) == docs.count()
    odd = [r for r in got if r["doc_id"] in (2, 3, 4) and r["lang_pred"] is None]
    assert len(odd) >= 3 and all(r["ambiguous"] and r["loss"] is None for r in odd)
    kept = language_id.keep_clear(docs)
    assert kept.columns == docs.columns
    assert all((r["text"] or "").strip() for r in kept.collect())


def test_language_id_without_labels_or_rows(spark):
    docs = corpus(spark, [(1, "some text here", None), (2, None, None)])
    assert language_id.fit(docs) is None
    assert all(r["ambiguous"] and r["lang_pred"] is None for r in language_id.identify(docs, None).collect())
    assert language_id.keep_clear(docs).count() == 2
    none = corpus(spark, [])
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    one = corpus(spark, [(1, "some text here"), (2, "more of the same text")])
    assert {r["lang_pred"] for r in language_id.identify(one, language_id.fit(one)).collect()} == {"en"}


def test_language_id_fits_on_every_labelled_row(spark):
    data = [(i, prose(i, 20 + i % 30, lang), lang) for i, lang in ((i, "en" if i % 4 else ("fr", "de")[i // 4 % 2]) for i in range(600))]
    docs = corpus(spark, data)
    model = language_id.fit(docs, max_train=100)
    for lang in WORDS:  # one more text, with a gram that no other has, shows in the model
        odd = corpus(spark, [(9999, "zqxj " * 200, lang)])
        assert (language_id.fit(docs.union(odd), max_train=100).weights != model.weights).any()
    again = language_id.fit(docs.repartition(7), max_train=100)
    assert (again.weights == model.weights).all() and (again.most_loss == model.most_loss).all() and (again.least_gap == model.least_gap).all()
    test = languages(5000, 90)
    got = {r["doc_id"]: r for r in language_id.identify(corpus(spark, test), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in test) >= 87
    assert sum(got[i]["ambiguous"] for i, _, _ in test) <= 5


def test_language_id_bounds_are_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    found = [(int(k), int(a), int(b)) for k, a, b in zip(rng.integers(0, 3, 5000), rng.integers(0, 9 * 10**5, 5000), rng.integers(0, 5 * 10**6, 5000), strict=True)] + [(7, 1, 1)]
    got = language_id.extremes(spark.createDataFrame(found, "level int, loss bigint, gap bigint"))
    want = {}
    for k in range(3):
        loss, gap = (np.array([r[c] for r in found if r[0] == k]) / 10**6 for c in (1, 2))
        want[k] = np.quantile(loss, 1 - language_id.OUT, method="higher"), np.quantile(gap, language_id.OUT, method="lower")
    assert got == want


def labelled(seed, n):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        words = prose(seed + i, 40 + i % 30).split()
        if bad:
            words = [w.upper() + "###" if rng.random() < 0.5 else w for w in words]
        if rude:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile"])
        docs.append((seed + i, " ".join(words)))
        labels.append((seed + i, int(not bad), int(rude)))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(0, 300)
    model = quality.fit(corpus(spark, docs), spark.createDataFrame(labels, LABELS))
    test, want = labelled(10_000, 150)
    got = {r["doc_id"]: r for r in quality.score(corpus(spark, test), model).collect()}
    assert np.mean([(got[i]["quality"] >= 0.5) == q for i, q, _ in want]) > 0.95
    assert np.mean([(got[i]["toxicity"] >= 0.5) == t for i, _, t in want]) > 0.95
    assert all(r["keep"] == (r["quality"] >= 0.5 and r["toxicity"] < 0.5) for r in got.values())


def test_factorisation_machine_equals_its_definition():
    rng = np.random.default_rng(0)
    d = quality.STATS + 5
    m = quality.Machine(0.3, rng.standard_normal(d), rng.standard_normal((d, 3)))
    model = quality.Model(np.arange(5), np.zeros(quality.STATS), np.ones(quality.STATS), {"quality": m})
    stats = rng.standard_normal((2, quality.STATS)).astype(np.float32).clip(-3, 3)
    x = np.zeros((2, d))
    x[:, : quality.STATS] = stats
    x[0, quality.STATS + np.array([1, 3])] = 1
    x[1, quality.STATS + 4] = 1
    want = [m.bias + v @ m.linear + sum(m.factors[i] @ m.factors[j] * v[i] * v[j] for i in range(d) for j in range(i)) for v in x]
    got = model.score("quality", stats, np.array([0, 0, 1]), np.array([1, 3, 4]))
    assert np.allclose(got, want, atol=1e-4)


def test_quality_odd_rows_and_labels(spark):
    docs = with_clashes(corpus(spark, ugly_rows()))
    labels = spark.createDataFrame([(5, 1, None), (6, 0, None), (None, 1, 1), (99, 0, 0), (7, None, None)], LABELS)
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == docs.count()
    assert all(r["toxicity"] is None for r in out)  # no document with a toxic label of either kind
    assert all(r["quality"] is None and not r["keep"] for r in out if r["doc_id"] in (1, 2, 3, 4))
    unlabelled = quality.score(docs, quality.fit(docs, spark.createDataFrame([], LABELS))).collect()
    assert all(r["quality"] is None and r["keep"] == (r["doc_id"] not in (1, 2, 3, 4) and r["doc_id"] is not None or r["keep"]) for r in unlabelled)
    assert quality.score(corpus(spark, []), None).count() == 0


def test_language_model_prefers_what_it_has_seen(spark):
    pattern = "the cat sat on the mat and the dog lay by the door then they slept"
    train = corpus(spark, [(i, " ".join([pattern] * 5)) for i in range(60)])
    net = language_model.train(train, listed=30, rest=16, width=8)
    words = pattern.split() * 4
    random.Random(1).shuffle(words)
    got = {r["doc_id"]: r for r in language_model.score(corpus(spark, [(1, pattern), (2, " ".join(words)), (3, "quite other things altogether here")]), net).collect()}
    assert got[1]["perplexity"] < got[2]["perplexity"] < got[3]["perplexity"]
    assert math.isclose(got[1]["perplexity"], math.exp(-got[1]["log_prob"]), rel_tol=1e-3)


def test_language_model_gives_each_word_its_own_probability(spark):
    often, seldom = "harbour", "lantern"
    docs = corpus(spark, [(i, f"the sea and the {often if i % 10 else seldom} there") for i in range(200)])
    net = language_model.train(docs, listed=4, rest=1, width=4)
    log_prob = {r["doc_id"]: r["log_prob"] for r in language_model.score(corpus(spark, [(1, often), (2, seldom), (3, "xylem"), (4, "the")]), net).collect()}
    assert log_prob[4] > log_prob[1] > log_prob[2] > log_prob[3]


def test_words_that_share_a_slot_have_their_own_probability(spark, monkeypatch):
    often = {f"word{k}": 1 + k for k in range(12)}
    docs = corpus(spark, [(i, " ".join([w] * n)) for i, (w, n) in enumerate(often.items())] + [(100, "the " * 50)])
    net = language_model.train(docs, listed=1, rest=1, width=1, slot_bits=2)
    got = []
    for kept in (1 << 18, 3):
        monkeypatch.setattr(language_model, "KEPT", kept)
        got.append(rows(language_model.score(corpus(spark, list(enumerate([*often, "the", "..."]))), net)))
        log_prob = {r[0]: r[2] for r in got[-1]}
        for k, n in enumerate(often.values()):
            assert math.isclose(log_prob[k] - log_prob[0], math.log(n), abs_tol=2e-4)
    assert got[0] == got[1]


def small_vocabulary(listed=3, rest=4, width=2, slots=16):
    words = np.array([5 << 44, 9 << 44, 77 << 44][:listed], np.uint64)
    n = np.random.default_rng(1).random(slots)
    whole = np.bincount(np.arange(slots) % rest, n)
    return language_model.Vocabulary(words, rest, width, np.log(n / whole[np.arange(slots) % rest]).astype(np.float32))


def test_language_model_probabilities_add_up():
    vocab = small_vocabulary()
    net = language_model.Net(vocab, bits=5)
    net.w = np.random.default_rng(0).standard_normal(net.w.shape).astype(np.float32)
    n = vocab.classes * vocab.width
    f = np.repeat(np.array([[3], [5], [7]], np.uint64), n, axis=1)
    assert math.isclose(sum(math.exp(v) for v in net.log_prob(f, np.arange(n))), 1, rel_tol=1e-4)
    for g in range(vocab.rest):
        assert math.isclose(np.exp(vocab.share[g :: vocab.rest].astype(float)).sum(), 1, rel_tol=1e-5)


def test_shares_of_a_corpus_add_up(spark):
    counts = language_model.counted(corpus(spark, [(i, prose(i, 50, fresh=True)) for i in range(20)]))
    vocab, often = language_model.vocabulary(counts, 5, 3, 4, 22)
    for g in range(3):
        assert math.isclose(np.exp(vocab.share[g::3].astype(float)).sum(), 1, rel_tol=1e-5)
    assert often.sum() >= 1000 and len(vocab.share) >= 2 * counts.count()


def test_ties_in_the_vocabulary_go_to_smaller_hashes(spark):
    words = ["ash", "birch", "cedar", "elm", "fir"]
    counts = language_model.counted(corpus(spark, [(i, w) for i, w in enumerate(words)] + [(9, "oak oak")]))
    vocab, _ = language_model.vocabulary(counts, 3, 2, 2, 22)
    signed = lambda w: int(np.uint64(_text.hash_word(w)).astype(np.int64))
    assert vocab.words.view(np.int64).tolist() == [signed("oak"), *sorted(map(signed, words))[:2]]


def test_one_training_step_equals_plain_loops():
    vocab = small_vocabulary()
    net = language_model.Net(vocab, bits=3)
    net.w = np.random.default_rng(0).standard_normal(net.w.shape).astype(np.float32)
    h = np.random.default_rng(2).integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2)
    h[::3] = 9 << 44
    f, (o, _) = language_model.features(h, np.array([0, 20, 50])), vocab.outcomes(h, vocab.places())
    met, expected = np.zeros((net.wide, len(net.w)), np.int64), np.zeros((net.wide, len(net.w)))
    net.add(f, o, met, expected)
    want_met, want = np.zeros_like(met), np.zeros_like(expected)
    for i in range(50):
        for rows_, bias, n, target in net.parts(f[:, i : i + 1], o[i : i + 1]):
            z = [float(net.w[bias[0], k]) + sum(float(net.w[r[0], k]) for r in rows_) for k in range(n)]
            total = sum(math.exp(v) for v in z)
            for r in rows_:
                want_met[target[0], r[0]] += 1
                for k in range(n):
                    want[k, r[0]] += language_model.SCALE * math.exp(z[k]) / total
    assert (met == want_met).all() and np.abs(expected - want).max() <= 0.51 * met.sum(0).max()
    before, w = net.log_prob(f, o).sum(), net.w
    net.step(met.T, expected.T / language_model.SCALE, 0.3, 1.0)
    k, r = np.argwhere(met > 0)[0]
    e = want[k, r] / language_model.SCALE
    assert math.isclose(net.w[r, k] - w[r, k], min(1, 0.3 * (met[k, r] - e) / (e + 1)), abs_tol=1e-3)
    assert net.log_prob(f, o).sum() > before


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    nets = [language_model.train(docs.repartition(n), listed=48, rest=24, bits=10) for n in (2, 16)]
    assert (nets[0].w == nets[1].w).all() and (nets[0].v.share == nets[1].v.share).all()
    assert rows(language_model.score(docs.repartition(3), nets[0])) == rows(language_model.score(docs.repartition(11), nets[1]))


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
from weftframe.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("op3_lm_scoring", "op7_embedding_caps", "op9_language_id"):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)


def test_language_model_odd_rows(spark):
    docs = with_clashes(corpus(spark, ugly_rows()))
    out = rows(language_model.score(docs, language_model.train(docs, listed=20, rest=8, width=4, bits=8)))
    assert len(out) == docs.count()
    for doc_id, n, log_prob, perplexity in out:
        assert (n == 0) == (log_prob is None) == (perplexity is None)
        if doc_id in (1, 2, 3, 4):
            assert n == 0
    none = corpus(spark, [])
    assert language_model.score(none, language_model.train(none)).count() == 0


def test_features_stay_within_their_row():
    h = np.arange(1, 7, dtype=np.uint64)
    f = language_model.features(h, np.array([0, 3, 3, 4, 6]))
    alone = [language_model.features(h[a:b], np.array([0, b - a])) for a, b in ((0, 3), (3, 4), (4, 6))]
    assert (f == np.concatenate(alone, 1)).all()


def test_plain_text():
    assert _text.plain_text("Où, ÉTÉ--x1!\n× 中") == "où été x1 × 中".encode().decode("latin-1")

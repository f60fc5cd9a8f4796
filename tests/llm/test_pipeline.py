"""The pipeline against brute force on a small corpus, and on odd rows."""

import shutil
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from weftframe.llm import language_id

from .helpers import corpus, prose, ugly_rows, with_clashes
from .test_decontaminate import brute as brute_leaks
from .test_jaccard import brute as brute_classes
from .test_jaccard import near_copies

BENCH = [(1, prose(70, 30, fresh=True)), (2, prose(71, 25, fresh=True)), (3, "short")]


def sample():
    passage = prose(60, 80, fresh=True)
    data = [(i, prose(i, 70 + i, lang, fresh=True), lang) for i in range(24) for lang in [("en", "fr", "de")[i % 3]]]
    data += [(i, t) for i, t in near_copies(1, prose(61, 120, fresh=True), 8, 0.01, 100)]
    data += [(200 + i, f"{prose(200 + i, 150, fresh=True)} {passage} {prose(300 + i, 150, fresh=True)}") for i in range(4)]
    data += [(300, f"{prose(80, 60, fresh=True)} {BENCH[0][1]} {prose(81, 60, fresh=True)}"), (301, f"{prose(82, 60, fresh=True)} {BENCH[1][1][:-1]}x"), (400, "中文 @@ ###"), (401, "")]
    return data


def words(text):
    return [w for w in "".join(c if c > " " else " " for c in text or "").split(" ") if w]


def judged(model, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return bool(language_id.judged(model, data, np.array([0, len(data)]), 0.02)[3][0])


def brute_cut(data, k=50):
    """Each text without the words of windows that an earlier place has, in order of id and position."""
    seen, out = set(), []
    for i, t in sorted(data):
        w = words(t)
        gone = set()
        for a in range(len(w) - k + 1):
            window = tuple(w[a : a + k])
            if window in seen:
                gone.update(range(a, a + k))
            seen.add(window)
        left = [x for n, x in enumerate(w) if n not in gone]
        if left or not w:
            out.append((i, " ".join(left)))
    return out


@pytest.fixture
def folder(spark, tmp_path):
    def make(docs, bench):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    yield make
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_stages_equal_brute_force(spark, folder):
    data = sample()
    d = folder(corpus(spark, data), BENCH)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = language_id.fit(docs)
    clear = [(r[0], r[1]) for r in data if not judged(model, r[1])]
    names = [(100 + i) for i in range(8)]
    root = {i: c for i, c, _ in brute_classes(clear, 0.5)}
    single = [(i, t) for i, t in clear if root[i] in (None, i)]
    fresh = brute_cut(single)
    leaks = {r[0] for r in brute_leaks(fresh, BENCH)}
    left = {i: len(words(t)) for i, t in fresh if i not in leaks}
    assert 401 not in {i for i, _ in clear} and sum(i in dict(single) for i in names) == 1 and leaks == {300, 301}
    got = [r.asDict() for r in corpus_pipeline.run(spark, d).collect()]
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["part_words"]
    assert have == Counter(left)
    used = Counter()
    for r in got:
        used[r["bin"]] += r["part_words"]
    assert max(used.values()) <= 2048 and len(used) <= 2 * sum(left.values()) // 2048 + 1


def test_stages_keep_columns_and_survive_odd_rows(spark, folder):
    odd = with_clashes(corpus(spark, ugly_rows() + sample()))
    d = folder(odd, [(None, None), (1, ""), *BENCH, *BENCH])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert out.dtypes == docs.dtypes
        docs = out
    assert corpus_pipeline.run(spark, d).count() > 0


def test_empty_corpus(spark, folder):
    d = folder(corpus(spark, []), [])
    assert corpus_pipeline.run(spark, d).count() == 0


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "decontamination", "best_fit_packing"]
